"""Inputs of the queries, derived from whole tables by fixed rules, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rubrics
from ..common import literal, parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


DIM = "dim(section_ord, section, element_ord, category, max_score) AS (VALUES " + ", ".join(f"({a}, {_quoted(b)}, {c}, {_quoted(d)}, {e})" for a, b, c, d, e in rubrics.elements()) + ")"
SECTIONS = "sections(section_ord, section) AS (VALUES " + ", ".join(f"({k}, {_quoted(s)})" for k, (s, *_) in enumerate(rubrics.sections())) + ")"


def plan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of plans: a plan is a nation and a year of orders, an element is the part's rest modulo 76."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    dim = rubrics.dimension(spark).select("element_ord", "category", "max_score")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.withColumn("element_ord", (F.col("l_partkey") % 76).cast("int")).join(dim, "element_ord")
    score = (F.floor("l_quantity") % (F.col("max_score") + 1)).cast("double")
    return rows.select("country", "year", "category", score.alias("score"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("position"))


FACTS = f"""{DIM}, facts AS (
  SELECT n_name AS country, CAST(year(o_orderdate) AS VARCHAR) AS year, category, section, section_ord, max_score,
    CAST(CAST(floor(l_quantity) AS BIGINT) % (max_score + 1) AS DOUBLE) AS score, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN dim ON element_ord = l_partkey % 76)"""
LAST_FIRST = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return docs.select("doc_id", (F.col("at") + 1).alias("page_number"), "text")


def rubric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as entries: sentences are indicators, the first two of them criteria for even items."""
    from ..functions.text import sentences

    item, said = F.col("item_id"), sentences(F.col("text"))
    criteria = F.when(item % 2 == 0, F.slice(said, 1, 2)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "benchmark").select(item.cast("int").alias("ordinal"), item.cast("string").alias("category"), F.col("text").alias("definition"), said.alias("indicators"), criteria.alias("scoring_definitions"))


def _sentences(x: str, longer_than: int = 0) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > {longer_than})"


ENTRIES = f"""said AS (SELECT item_id, text, {_sentences('text')} AS indicators FROM benchmark),
entries AS (SELECT CAST(item_id AS INTEGER) AS ordinal, CAST(item_id AS VARCHAR) AS category, text AS definition, indicators,
  CASE WHEN item_id % 2 = 0 THEN indicators[1:2] ELSE [] END AS scoring_definitions FROM said)"""


def chat_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as analyses: the item by conv_id, the reasoning is what was said just before."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n_items"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).filter("role = 'assistant'").crossJoin(F.broadcast(n))  # one row
    return rows.select(F.col("conv_id").alias("doc_id"), "turn", (F.col("conv_id") % F.col("n_items")).cast("string").alias("category"), F.col("text").alias("response"), F.coalesce("before", F.lit("")).alias("scoring_reasoning"), ((F.col("conv_id") + F.col("turn")) % 6).cast("int").alias("score"))


ANALYSES = """turns AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
analyses AS (SELECT conv_id AS doc_id, turn, CAST(conv_id % (SELECT count(*) FROM benchmark) AS VARCHAR) AS category, text AS response,
  coalesce(before, '') AS scoring_reasoning, CAST((conv_id + turn) % 6 AS INTEGER) AS score FROM turns WHERE role = 'assistant')"""


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of numbers for every order line: every kind of entity occurs. Lines of an order are in one part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    n = parts(li)
    li = li.repartition(n, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority").repartition(n, "o_orderkey")
    price = F.floor("l_extendedprice").cast("long")
    text = F.concat(
        F.when(F.col("l_partkey") % 3 == 0, "The target of ").when(F.col("l_partkey") % 3 == 1, "In stage ").otherwise("About "), F.col("l_linenumber").cast("string"), F.lit(" plans for "), F.col("year").cast("string"), F.lit(" cost $"), price.cast("string"),
        F.when(F.col("l_partkey") % 2 == 0, " million").otherwise(" by"), F.lit(" or "), F.format_number(price, 0), F.lit(" units at "), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit(".5 % off; "), F.floor("l_quantity").cast("long").cast("string"), F.lit(" of them"),
    )
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_number"), text.alias("text"))


NARRATIVE = """narrative AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_number,
    (CASE l_partkey % 3 WHEN 0 THEN 'The target of ' WHEN 1 THEN 'In stage ' ELSE 'About ' END) || l_linenumber || ' plans for ' || year(o_orderdate) || ' cost $' || CAST(floor(l_extendedprice) AS BIGINT)
    || (CASE WHEN l_partkey % 2 = 0 THEN ' million' ELSE ' by' END) || ' or ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ' units at ' || CAST(round(l_discount * 100) AS BIGINT) || '.5 % off; ' || CAST(floor(l_quantity) AS BIGINT) || ' of them' AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as windows: every vector is a query, and a window of the page that its label numbers."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), v.select(F.col("label").cast("int").alias("page_number"), F.col("embedding").alias("vector"))


SIMILAR = """dots AS (SELECT q.vec_id AS query, CAST(p.label AS INTEGER) AS page_number,
    list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS d FROM embeddings q CROSS JOIN embeddings p),
  similar_ AS (SELECT query, page_number, max(d) AS similarity FROM dots GROUP BY ALL)"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of analysis files: a year, a range of years, hyphens, no year."""
    base = plan_names(spark, sf_dir)
    c, y = F.col("country"), F.col("year")
    forms = F.array(F.concat(c, F.lit("_"), y, F.lit(".json")), F.concat(c, F.lit("_"), y, F.lit("_"), (y.cast("int") + 10).cast("string"), F.lit(".json")), F.concat(F.lit("New-"), c, F.lit("_"), y, F.lit(".json")), F.concat(c, F.lit(".json")))
    return base.select(F.explode(forms).alias("filename")).distinct()


def plan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("country", "year").distinct()  # 25 nations


PLANS = "plans AS (SELECT DISTINCT n_name AS country, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
FILE_NAMES = f"""{PLANS}, names AS (SELECT DISTINCT unnest([country || '_' || year || '.json', country || '_' || year || '_' || (CAST(year AS INTEGER) + 10) || '.json', 'New-' || country || '_' || year || '.json', country || '.json']) AS filename FROM plans)"""


def analysis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per plan, as text: an entry per fact; every seventh order's lacks its response. Three more are no good."""
    facts = plan_facts(spark, sf_dir)
    gap = F.col("position.l_orderkey") % 7 == 0
    none = F.array().cast("array<int>")
    entry = F.struct("category", F.when(~gap, F.lit("text")).alias("response"), none.alias("response_page_citations"), F.col("score").cast("int").alias("score"), F.lit("why").alias("scoring_reasoning"), none.alias("scoring_reasoning_page_citations"))
    got = facts.groupBy("country", "year").agg(F.collect_list(F.struct("position", entry.alias("entry"))).alias("all"))
    raw = F.to_json(F.transform(F.sort_array("all"), lambda a: a["entry"]))  # sort_array: array_sort calls a lambda for each comparison
    bad = literal(spark, [("bad.json", "{not json"), ("object.json", '{"a": 1}'), ("odd.json", '[1, {"score": 2}, {"category": "Health"}, {"category": "Else"}, {"category": "Health", "score": null}]')], ["filename", "raw"])
    return got.select(F.concat("country", F.lit("_"), "year", F.lit(".json")).alias("filename"), raw.alias("raw")).union(bad)


def loose_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects for repair, one per event, of seven kinds by event_id."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    q = F.lit('"')
    cite = F.lit(',"response_page_citations":[1,"2","x",null,3.7],"scoring_reasoning_page_citations":[]')
    head = F.concat(F.lit('{"category":"c","response":"r"'))
    kind = F.col("event_id") % 7
    score = F.when(kind == 0, F.col("k").cast("string")).when(kind == 1, F.concat(q, F.col("k").cast("string"), q)).when(kind == 2, F.lit('"many"')).when(kind == 3, F.lit("null")).when(kind == 4, F.lit("2.9")).when(kind == 5, F.lit("true"))
    body = F.concat(head, F.when(score.isNotNull(), F.concat(F.lit(',"score":'), score)).otherwise(""), F.when(kind != 6, F.concat(F.lit(',"scoring_reasoning":"s"'), cite)).otherwise(',"response_page_citations":"none"'), F.lit("}"))
    return e.select("event_id", "k", F.lit("right").alias("category"), F.try_parse_json(body).alias("entry"))

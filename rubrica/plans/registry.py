"""The queries: each applies operators to whole tables. Next to each stands the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rubrics
from ..common import staged
from ..functions import entities as E
from ..functions import text as T
from ..operators import attribution, quality, rubric, scores, similarity, validate
from ..operators.remediation import remediate
from ..sources import analyses as A
from ..sources import pages as P
from ..sources import sinks
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents")


# Scores ---------------------------------------------------------------------------------------------------------------------

_LAST = f"last_ AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY country, year, category ORDER BY {X.LAST_FIRST}) = 1)"
_SECTION = f"""WITH {X.FACTS}, {X.SECTIONS}, {_LAST},
means AS (SELECT country, year, section, avg(score / max_score * 5.0) AS m FROM last_ GROUP BY ALL),
plans AS (SELECT DISTINCT country, year FROM facts),
per AS (SELECT country, year, section_ord, section, coalesce(m, 0.0) AS score FROM plans CROSS JOIN sections LEFT JOIN means USING (country, year, section))"""


@query(f"{_SECTION} SELECT country, year, section, round(score, 6) AS score FROM per")
def section_scores(spark, sf_dir):
    return scores.section_scores(X.plan_facts(spark, sf_dir)).select("country", "year", "section", r6("score").alias("score"))


@query(f"WITH {X.FACTS} SELECT country, year, round(median(score / max_score * 5.0), 6) AS overall, count(*) AS n_scores FROM facts GROUP BY ALL")
def overall_median(spark, sf_dir):
    return scores.overall_scores(X.plan_facts(spark, sf_dir)).select("country", "year", r6("overall").alias("overall"), "n_scores")


@query(f"{_SECTION} SELECT country || ' (' || year || ')' AS label, " + ", ".join(f"round(max(score) FILTER (section_ord = {k}), 6) AS s{k}" for k in range(12)) + " FROM per GROUP BY country, year")
def country_section_matrix(spark, sf_dir):
    wide = scores.comparison(X.plan_facts(spark, sf_dir))
    return wide.select("label", *[r6(F.col(f"`{s}`")).alias(f"s{k}") for k, (s, *_) in enumerate(rubrics.sections())])


@query(f"""WITH {X.FACTS}, o AS (SELECT median(score / max_score * 5.0) AS overall FROM facts GROUP BY country, year)
SELECT count(*) AS total_plans, round(median(overall), 6) AS median_overall, round(avg(overall), 6) AS mean_overall FROM o""")
def summary_stats(spark, sf_dir):
    return scores.summary(X.plan_facts(spark, sf_dir)).select("total_plans", r6("median_overall").alias("median_overall"), r6("mean_overall").alias("mean_overall"))


_MEDIANS = f"""WITH {X.FACTS}, m AS (SELECT section_ord, section, median(score / max_score * 5.0) AS median, avg(score / max_score * 5.0) AS mean, count(*) AS n_scores FROM facts GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY median DESC, section_ord) AS INTEGER) AS rank, CAST(count(*) OVER () AS INTEGER) AS n FROM m)"""


@query(f"{_MEDIANS} SELECT section, round(median, 6) AS median, round(mean, 6) AS mean, n_scores, rank FROM r")
def section_medians(spark, sf_dir):
    return scores.section_medians(X.plan_facts(spark, sf_dir)).select("section", r6("median").alias("median"), r6("mean").alias("mean"), "n_scores", "rank")


@query(f"""{_MEDIANS} SELECT 'highest' AS list, rank, section, round(median, 6) AS median FROM r WHERE rank <= 3
UNION ALL SELECT 'lowest', CAST(rank - n + 3 AS INTEGER), section, round(median, 6) FROM r WHERE rank > n - 3""")
def top_bottom_sections(spark, sf_dir):
    found = scores.top_and_bottom(X.plan_facts(spark, sf_dir))
    return found.select("list", F.col("rank").cast("int").alias("rank"), "section", r6("median").alias("median"))


@query(f"WITH {X.FACTS} SELECT country, year, category, count(*) AS n_rows, round(sum(score / max_score * 5.0), 6) AS total FROM facts GROUP BY ALL")
def normalised_totals(spark, sf_dir):
    known = scores.known_scores(X.plan_facts(spark, sf_dir))
    return known.groupBy("country", "year", "category").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("norm")).alias("total"))


# Text -----------------------------------------------------------------------------------------------------------------------

_TOK = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"
_SYL1 = "list_transform({0}, lambda w: len(regexp_extract_all(lower(w), '[aeiouy]+')))"
_SYL = lambda toks: f"list_sum(list_transform({toks}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN lower(w) LIKE '%e' AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(w), '[^aeiouy]le$') THEN 1 ELSE 0 END)))"


def _measured(source: str, text: str, keys: str) -> str:
    """SQL: w (words), s (sentences), y (syllables), grade, ease, readability of a text."""
    return f"""tok_ AS (SELECT {keys}, {text} AS text, {_TOK(text)} AS toks, {X._sentences(text)} AS sents FROM {source}),
cnt_ AS (SELECT *, len(toks) AS w, len(sents) AS s, {_SYL('toks')} AS y FROM tok_),
fk_ AS (SELECT *, CASE WHEN w = 0 OR s = 0 THEN 0.0 ELSE greatest(0.39 * (w / s) + 11.8 * (y / w) - 15.59, 0.0) END AS grade,
  CASE WHEN w = 0 OR s = 0 THEN 0.0 ELSE greatest(least(206.835 - 1.015 * (w / s) - 84.6 * (y / w), 100.0), 0.0) END AS ease FROM (SELECT * REPLACE (CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s, CAST(y AS DOUBLE) AS y) FROM cnt_)),
measured AS (SELECT *, CASE WHEN w < 10 THEN 0.0 ELSE ((CASE WHEN grade BETWEEN 12 AND 16 THEN 1.0 WHEN grade < 8 OR grade > 22 THEN 0.3 ELSE 0.7 END)
  + (CASE WHEN ease BETWEEN 30 AND 60 THEN 1.0 WHEN ease < 10 OR ease > 80 THEN 0.3 ELSE 0.7 END)) / 2 END AS readability FROM fk_)"""


def _cohered(source: str, keys: str) -> str:
    """SQL: coherence, from columns text and w."""
    sets = X._sentences("lower(text)", 10)
    return f"""coh_ AS (SELECT {keys}, w, list_transform({sets}, lambda s: list_distinct({_TOK('s')})) AS sets FROM {source}),
cohered AS (SELECT {keys}, CASE WHEN w < 20 OR len(sets) < 2 THEN 0.5 ELSE least(2 * list_avg(list_transform(range(1, len(sets)), lambda i:
  CAST(len(list_intersect(sets[i], sets[i + 1])) AS DOUBLE) / least(len(sets[i]), len(sets[i + 1])))), 1.0) END AS coherence FROM coh_)"""


_DOCS = f"WITH {_measured('documents', 'text', 'doc_id')}"


@query(f"SELECT doc_id, CAST(len({_TOK('text')}) AS INTEGER) AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).alias("n_words"))


@query(f"""WITH t AS (SELECT doc_id, {_TOK('text')} AS k FROM documents), s AS (SELECT doc_id, k, unnest(range(0, greatest(len(k) - 50, 0) + 1, 25)) AS i FROM t WHERE len(k) > 0)
SELECT doc_id, CAST(i // 25 AS INTEGER) AS window_no, array_to_string(k[i + 1 : i + 50], ' ') AS window_text FROM s""")
def token_windows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.token_windows(F.col("text"))).alias("window_no", "window_text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, sha256(string_agg('--- PAGE ' || n || ' ---' || chr(10) || line, chr(10) || chr(10) ORDER BY n)) AS sha, count(*) AS n_pages FROM l GROUP BY doc_id""")
def page_text_concat(spark, sf_dir):
    p = X.pages(spark, sf_dir)
    return P.full_text(p).join(p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")), "doc_id").select("doc_id", F.sha2("full_text", 256).alias("sha"), "n_pages")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT doc_id, coalesce(lines[2], '') AS text FROM l")
def page_lookup(spark, sf_dir):
    return P.page_text(X.pages(spark, sf_dir), 2)


@query(f"{_DOCS} SELECT doc_id, CAST(coalesce(y, 0) AS INTEGER) AS n_syllables FROM measured")
def syllables(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.syllables(F.col("text")).alias("n_syllables"))


@query(f"{_DOCS} SELECT doc_id, round(grade, 6) AS grade FROM measured")
def fk_grade(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.grade_level(F.col("text"))).alias("grade"))


@query(f"{_DOCS} SELECT doc_id, round(ease, 6) AS ease FROM measured")
def reading_ease(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.reading_ease(F.col("text"))).alias("ease"))


@query(f"{_DOCS} SELECT doc_id, round(readability, 6) AS readability FROM measured")
def readability_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.readability(F.col("text"))).alias("readability"))


@query(f"{_DOCS}, {_cohered('measured', 'doc_id')} SELECT doc_id, round(coherence, 6) AS coherence FROM cohered")
def coherence_heuristic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(T.coherence(F.col("text"))).alias("coherence"))


_LINE = """CASE WHEN x = upper(x) AND x <> lower(x) AND length(x) < 100 THEN '<h1>' || x || '</h1>'
  WHEN x LIKE '#%' THEN '<h' || least(length(regexp_extract(x, '^#+')), 6) || '>' || trim(regexp_replace(x, '^[# ]+', '')) || '</h' || least(length(regexp_extract(x, '^#+')), 6) || '>'
  WHEN regexp_matches(x, '^[-•*] ') THEN '<li>' || substr(x, 3) || '</li>' WHEN regexp_matches(x, '^[1-5]\\.') THEN '<li>' || x || '</li>' ELSE '<p>' || x || '</p>' END"""
_HTML = lambda text: f"array_to_string(list_transform(list_filter(list_transform(string_split({text}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), lambda x: {_LINE}), chr(10))"


def _marked(text: Column) -> Column:
    """Documents with headings and lists, by doc_id."""
    mark = F.when(F.col("doc_id") % 4 == 0, "## heading\n- item\n1. first\n# HEAD\n").when(F.col("doc_id") % 4 == 1, "TITLE IN CAPITALS\n* star\n• dot\n6. sixth\n").otherwise("")
    return F.concat(mark, text)


_MARKED = "(CASE doc_id % 4 WHEN 0 THEN '## heading' || chr(10) || '- item' || chr(10) || '1. first' || chr(10) || '# HEAD' || chr(10) WHEN 1 THEN 'TITLE IN CAPITALS' || chr(10) || '* star' || chr(10) || '• dot' || chr(10) || '6. sixth' || chr(10) ELSE '' END) || text"


@query(f"SELECT doc_id, {_HTML(_MARKED)} AS html FROM documents")
def text_to_html(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.to_html(_marked(F.col("text"))).alias("html"))


_FLAGS = "SELECT {key} AS id, '{name}' AS kind, contains(lower({html}), '<table') OR contains({text}, '│') OR contains({text}, '+-') AS has_tables, contains(lower({html}), '<figure') OR contains(lower({html}), '<img') OR contains(lower({text}), '[figure') AS has_figures FROM {table}"
_DOC_HTML = "'<p>' || text || '</p>' || CASE WHEN doc_id % 5 = 0 THEN '<TABLE>' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '<figure>' ELSE '' END"


@query(_FLAGS.format(key="page_id", name="page", html="html", text="url", table="pages") + " UNION ALL " + _FLAGS.format(key="doc_id", name="document", html=_DOC_HTML, text="text", table="documents"))
def layout_flags(spark, sf_dir):
    page = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "html", F.col("url").alias("text"))
    html = F.concat(F.lit("<p>"), "text", F.lit("</p>"), F.when(F.col("doc_id") % 5 == 0, "<TABLE>").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "<figure>").otherwise(""))
    rows = page.union(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), html.alias("html"), "text"))
    return rows.select("id", "kind", T.has_tables(F.col("html"), F.col("text")).alias("has_tables"), T.has_figures(F.col("html"), F.col("text")).alias("has_figures"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 3000 THEN left(text, 3000) || '...' ELSE text END) AS sha FROM documents")
def truncated_pages(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.truncated(F.col("text"), T.PAGE_LIMIT), 256).alias("sha"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z_\\-]', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def safe_names(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


_FENCED = """CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN '```' || props || '```' WHEN 2 THEN '```' || event_type || chr(10) || props || '``` and ```json []```'
  WHEN 3 THEN '```json ' || props ELSE props END"""


@query(f"WITH r AS (SELECT event_id, {_FENCED} AS reply FROM events) SELECT event_id, CASE WHEN regexp_matches(reply, '```(?:json)?\\s*([\\s\\S]*?)\\s*```') THEN regexp_extract(reply, '```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1) ELSE reply END AS json FROM r")
def unfenced_json(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    rest = F.col("event_id") % 5
    reply = F.when(rest == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).when(rest == 1, F.concat(F.lit("```"), "props", F.lit("```"))).when(rest == 2, F.concat(F.lit("```"), "event_type", F.lit("\n"), "props", F.lit("``` and ```json []```"))).when(rest == 3, F.concat(F.lit("```json "), "props")).otherwise(F.col("props"))
    return e.select("event_id", T.unfenced(reply).alias("json"))


@query(f"""WITH {X.FILE_NAMES}, b AS (SELECT filename, replace(filename, '.json', '') AS base FROM names)
SELECT filename, translate(CASE WHEN regexp_matches(base, '^(.+?)_(\\d{{4}})_(\\d{{4}})$') THEN regexp_extract(base, '^(.+?)_(\\d{{4}})_(\\d{{4}})$', 1) WHEN regexp_matches(base, '^(.+?)_(\\d{{4}})$') THEN regexp_extract(base, '^(.+?)_(\\d{{4}})$', 1) ELSE base END, '_-', '  ') AS country,
CASE WHEN regexp_matches(base, '^(.+?)_(\\d{{4}})_(\\d{{4}})$') THEN regexp_extract(base, '^(.+?)_(\\d{{4}})_(\\d{{4}})$', 2) || '-' || regexp_extract(base, '^(.+?)_(\\d{{4}})_(\\d{{4}})$', 3) WHEN regexp_matches(base, '^(.+?)_(\\d{{4}})$') THEN regexp_extract(base, '^(.+?)_(\\d{{4}})$', 2) ELSE 'Unknown' END AS year FROM b""")
def country_year_parse(spark, sf_dir):
    country, year = T.country_and_year(F.col("filename"))
    return X.file_names(spark, sf_dir).select("filename", country.alias("country"), year.alias("year"))


# Entities -------------------------------------------------------------------------------------------------------------------

_KW = "[" + ", ".join(f"'{w}'" for w in E.CONTEXT_WORDS) + "]"
_SMALL = f"""digits AS (SELECT doc_id, page_number, text, unnest(range(1, length(text) + 1)) AS i FROM narrative),
runs_ AS (SELECT doc_id, page_number, text, i, regexp_extract(substr(text, i), '^0*[1-9]') AS entity FROM digits WHERE NOT regexp_matches(substr(' ' || text, i, 1), '\\w')),
small AS (SELECT doc_id, page_number, entity FROM runs_ WHERE entity <> '' AND NOT regexp_matches(substr(text || ' ', i + length(entity), 1), '\\w')
  AND len(list_filter({_KW}, lambda k: contains(lower(substr(text, greatest(i - 50, 1), least(i - 1, 50) + length(entity) + 50)), k))) > 0)"""
_ENT = f"""WITH {X.NARRATIVE}, {_SMALL}, kinds AS (
  SELECT DISTINCT doc_id, page_number, 'percentage' AS kind, unnest(regexp_extract_all(text, '(\\d+\\.?\\d*)\\s*%', 1)) || '%' AS entity FROM narrative
  UNION SELECT doc_id, page_number, 'year', unnest(list_filter(regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER) BETWEEN 1990 AND 2099)) FROM narrative
  UNION SELECT doc_id, page_number, 'money', unnest(list_transform(regexp_extract_all(text, '(?i)(?:USD|\\$|€|£|¥)\\s*(\\d[\\d,]*\\.?\\d*)\\s*(?:million|billion|trillion|[MBT])?', 0), lambda m: trim(m))) FROM narrative
  UNION SELECT doc_id, page_number, 'grouped', unnest(regexp_extract_all(text, '\\b(\\d{{1,3}}(?:,\\d{{3}})+)\\b', 1)) FROM narrative
  UNION SELECT doc_id, page_number, 'integer', unnest(list_filter(regexp_extract_all(text, '\\b\\d+\\b', 0), lambda n: CAST(n AS BIGINT) >= 10)) FROM narrative
  UNION SELECT doc_id, page_number, 'integer', entity FROM small)"""


def _of_pages(rows: DataFrame, found: Column) -> DataFrame:
    """doc_id, page_number, entity: each once a page. Rows of a page are brought together whole, before what was found is taken apart."""
    pages = rows.select("doc_id", "page_number", found.alias("found")).groupBy("doc_id", "page_number").agg(F.collect_list("found").alias("all"))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.array_distinct(F.flatten("all")))
    return pages.select("doc_id", "page_number", F.explode(one).alias("entity"))


@query(f"{_ENT} SELECT kind, entity, count(*) AS n_pages FROM (SELECT DISTINCT * FROM kinds WHERE kind <> 'integer') GROUP BY ALL")
def entities_basic(spark, sf_dir):
    t = F.col("text")
    kinds = {"percentage": E.percentages(t), "year": E.years(t), "money": E.money(t), "grouped": E.grouped_numbers(t)}
    marked_as = lambda k, v: F.transform(v, lambda x: F.concat(F.lit(f"{k} "), x))
    marked = F.concat(*[marked_as(k, v) for k, v in kinds.items()])
    rows = _of_pages(X.narrative(spark, sf_dir), F.array_distinct(marked)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_pages"))
    kind = F.substring_index("entity", " ", 1)
    return rows.select(kind.alias("kind"), F.substring(F.col("entity"), F.char_length(kind) + 2, F.char_length("entity")).alias("entity"), "n_pages")


@query(f"{_ENT} SELECT doc_id, page_number, entity FROM kinds WHERE kind = 'integer'")
def entities_context_int(spark, sf_dir):
    return _of_pages(X.narrative(spark, sf_dir), F.array_distinct(E.integers(F.col("text"))))


@query(f"""{_ENT}, e AS (SELECT DISTINCT doc_id, page_number, entity FROM kinds), f AS (SELECT doc_id, min(page_number) AS p FROM narrative GROUP BY doc_id),
own AS (SELECT DISTINCT e.doc_id, entity FROM e JOIN f ON e.doc_id = f.doc_id AND e.page_number = f.p)
SELECT DISTINCT doc_id, page_number FROM own JOIN e USING (doc_id, entity)""")
def entity_page_match(spark, sf_dir):
    rows = X.narrative(spark, sf_dir)  # in parts of whole documents, which nothing here sends again
    first = rows.groupBy("doc_id").agg(F.min("page_number").alias("first"))
    texts = rows.join(first, "doc_id").filter("page_number = first").select("doc_id", "text")
    return attribution.entity_pages(texts, rows, ("doc_id",))


# Similarity -----------------------------------------------------------------------------------------------------------------

def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(similarity.page_similarity(*X.windows(spark, sf_dir), group=()), "similar")


_CUT = f"""{X.SIMILAR}, run_ AS (SELECT query, similarity, row_number() OVER w AS n1, sum(similarity) OVER (w ROWS UNBOUNDED PRECEDING) AS s1,
    count(*) OVER (PARTITION BY query) AS n, sum(similarity) OVER (PARTITION BY query) AS s FROM similar_ WINDOW w AS (PARTITION BY query ORDER BY similarity, page_number)),
  cut_ AS (SELECT query, (s1 / n1 + (s - s1) / (n - n1)) / 2 AS middle FROM run_ WHERE n > n1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC, n1) = 1),
  level_ AS (SELECT query, CASE WHEN min(similarity) = max(similarity) THEN min(similarity) WHEN count(*) < 3 THEN median(similarity) ELSE any_value(middle) END AS threshold FROM similar_ LEFT JOIN cut_ USING (query) GROUP BY query)"""


@query(f"WITH {X.SIMILAR} SELECT query, page_number, round(similarity, 6) AS similarity FROM similar_")
def semantic_page_max(spark, sf_dir):
    return similarity.page_similarity(*X.windows(spark, sf_dir), group=()).select("query", "page_number", r6("similarity").alias("similarity"))


@query(f"WITH {_CUT} SELECT query, round(threshold, 6) AS threshold FROM level_")
def adaptive_threshold(spark, sf_dir):
    return similarity.adaptive_threshold(_similar(spark, sf_dir), ("query",)).select("query", r6("threshold").alias("threshold"))


@query(f"WITH {_CUT} SELECT query, page_number FROM similar_ JOIN level_ USING (query) WHERE similarity >= threshold")
def semantic_match(spark, sf_dir):
    return similarity.similar_pages(_similar(spark, sf_dir), ("query",)).select("query", "page_number")


@query(f"WITH {X.SIMILAR}, l AS (SELECT query, quantile_cont(similarity, 0.25) AS level FROM similar_ GROUP BY query) SELECT query, page_number FROM similar_ JOIN l USING (query) WHERE similarity >= level - 1e-12")
def prefilter_p25(spark, sf_dir):
    return similarity.prefiltered_pages(_similar(spark, sf_dir), ("query",)).select("query", "page_number")


@query("""WITH d AS (SELECT q.vec_id AS query, p.vec_id AS ord, list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS s FROM embeddings q CROSS JOIN embeddings p)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, ord DESC) AS INTEGER) AS rank, ord, round(s, 6) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, ord DESC) <= 5""")
def topk_semantic(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings")
    found = similarity.top_k_by_vector(v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector")))
    return found.select("query", "rank", "ord", r6("similarity").alias("similarity"))


_TERMS = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda t: t <> ''))"


@query(f"""WITH q AS (SELECT doc_id AS query, {_TERMS('text')} AS a FROM documents), k AS (SELECT item_id AS ord, {_TERMS('text')} AS b FROM benchmark),
o AS (SELECT query, ord, len(list_intersect(a, b)) AS overlap FROM q CROSS JOIN k)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY overlap DESC, ord) AS INTEGER) AS rank, ord, overlap FROM o QUALIFY row_number() OVER (PARTITION BY query ORDER BY overlap DESC, ord) <= 5""")
def topk_keyword(spark, sf_dir):
    kb = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("content"))
    return similarity.top_k_by_terms(docs(spark, sf_dir).select(F.col("doc_id").alias("query"), "text"), kb).select("query", "rank", "ord", "overlap")


# Votes and attribution ------------------------------------------------------------------------------------------------------

_REPLIES = ["YES.", " no", "NOT SURE", "I think yes", "yes and no", "Maybe", "\tYes, it does", ""]


def _reply(key: Column, word: Column) -> Column:
    """One of the replies, and after it a word of the row, a refusal, a consent or nothing."""
    more = F.when(key % 5 == 0, F.concat(F.lit(" "), word)).when(key % 5 == 1, "").when(key % 5 == 2, "; No").otherwise(" yes.")
    return F.concat(F.element_at(F.array(*map(F.lit, _REPLIES)), (key % len(_REPLIES) + 1).cast("int")), more)


_SAID = "list_element([" + ", ".join("'" + r.replace("\t", "' || chr(9) || '") + "'" for r in _REPLIES) + "], CAST(({0}) % 8 + 1 AS INTEGER)) || CASE ({0}) % 5 WHEN 0 THEN ' ' || {1} WHEN 1 THEN '' WHEN 2 THEN '; No' ELSE ' yes.' END"
_YES = "CASE WHEN starts_with(upper(regexp_replace({0}, '^\\s+', '')), 'YES') THEN true WHEN starts_with(upper(regexp_replace({0}, '^\\s+', '')), 'NO') THEN false ELSE contains(upper({0}), 'YES') AND NOT contains(upper({0}), 'NO') END"


@query(f"WITH r AS (SELECT event_id, {_SAID.format('event_id', 'event_type')} AS reply FROM events) SELECT event_id, {_YES.format('reply')} AS yes FROM r")
def yes_no_parse(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", T.says_yes(_reply(F.col("event_id"), F.col("event_type"))).alias("yes"))


@query(f"""WITH s AS (SELECT event_id AS query, {_SAID.format('event_id * 5 + i * 3', 'event_type')} AS reply FROM events CROSS JOIN range(3) r(i)), v AS (SELECT query, {_YES.format('reply')} AS yes FROM s)
SELECT query, count(*) FILTER (yes) AS yes, count(*) FILTER (yes) >= 2 AS confirmed FROM v GROUP BY query""")
def majority_vote(spark, sf_dir):
    votes = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("query"), "event_type", F.posexplode(attribution.temperatures()).alias("i", "temperature"))
    votes = votes.withColumn("reply", _reply(F.col("query") * 5 + F.col("i") * 3, F.col("event_type")))
    return attribution.majority(votes, ("query",)).select("query", "yes", "confirmed")


@query(f"""WITH {_CUT}, b AS (SELECT query, page_number FROM similar_ JOIN level_ USING (query) WHERE similarity >= threshold),
m AS (SELECT query, page_number, (query * 7 + page_number * 3) % 5 < 2 AS a, b.query IS NOT NULL AS b, (query * 3 + page_number * 11) % 4 = 0 AND query % 2 = 0 AS c FROM similar_ LEFT JOIN b USING (query, page_number)),
n AS (SELECT *, count(*) FILTER (a AND b AND c) OVER g AS n3, count(*) FILTER (a AND b) OVER g AS ab, count(*) FILTER (a AND c) OVER g AS ac, count(*) FILTER (b AND c) OVER g AS bc FROM m WINDOW g AS (PARTITION BY query)),
t AS (SELECT *, CASE WHEN n3 > 0 THEN 'ABC' WHEN greatest(ab, ac, bc) = 0 THEN 'B' WHEN ab = greatest(ab, ac, bc) THEN 'AB' WHEN ac = greatest(ab, ac, bc) THEN 'AC' ELSE 'BC' END AS methods FROM n)
SELECT query, page_number, CASE length(methods) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, methods FROM t
WHERE CASE methods WHEN 'ABC' THEN a AND b AND c WHEN 'AB' THEN a AND b WHEN 'AC' THEN a AND c WHEN 'BC' THEN b AND c ELSE b END""")
def attribution_tiers(spark, sf_dir):
    s = _similar(spark, sf_dir)
    q, p = F.col("query"), F.col("page_number")
    a, c = s.filter((q * 7 + p * 3) % 5 < 2), s.filter(((q * 3 + p * 11) % 4 == 0) & (q % 2 == 0))
    found = attribution.combine(a, similarity.similar_pages(s, ("query",)), c, ("query",))
    return found.select("query", "page_number", "confidence", F.array_join("methods", "").alias("methods"))


# Quality --------------------------------------------------------------------------------------------------------------------

_COVER = f"""cov_ AS (SELECT a.doc_id, a.turn, a.category, response, scoring_reasoning, coalesce(definition, '') AS definition, coalesce(indicators, []) AS indicators,
    len({_TOK('response')}) AS rw, len({_TOK('scoring_reasoning')}) AS sw, {_TERMS('response')} AS rt FROM analyses a LEFT JOIN entries e ON a.category = e.category),
  cov2_ AS (SELECT *, list_filter(indicators, lambda i: len(list_filter({_TERMS('i')}, lambda t: contains(lower(response), t))) >= len({_TERMS('i')}) * 0.5) AS seen,
    list_distinct(list_transform(list_filter({_TOK('definition')}, lambda w: length(w) > 4), lambda w: lower(w))) AS dt FROM cov_),
  cov3_ AS (SELECT *, len(indicators) > 0 AND len(seen) / greatest(len(indicators), 1) < 0.3 AS few, definition <> '' AND len(list_intersect(dt, rt)) / greatest(len(dt), 1) < 0.2 AS off FROM cov2_),
  covered AS (SELECT *, greatest(1.0::DOUBLE - CASE WHEN rw < 30 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN sw < 20 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN few THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN off THEN 0.2::DOUBLE ELSE 0 END, 0) AS coverage,
    list_filter([CASE WHEN rw < 30 THEN 'Response too short (' || rw || ' words, minimum 30)' END, CASE WHEN sw < 20 THEN 'Reasoning too short (' || sw || ' words, minimum 20)' END,
      CASE WHEN few THEN 'Low indicator coverage (' || len(seen) || '/' || len(indicators) || ' indicators referenced)' END, CASE WHEN off THEN 'Response does not address key definition terms' END], lambda x: x IS NOT NULL) AS issues FROM cov3_)"""
_ASSESS = f"""WITH {X.ANALYSES}, {X.ENTRIES}, {_COVER}, {_measured('covered', "response || chr(10) || scoring_reasoning", 'doc_id, turn')}, {_cohered('measured', 'doc_id, turn')},
assessed AS (SELECT doc_id, turn, category, issues, 0.25 * readability + 0.25 * coherence + 0.25 * coverage + 0.25 AS composite, readability, coherence, coverage FROM covered JOIN measured USING (doc_id, turn) JOIN cohered USING (doc_id, turn))"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(X.chat_analyses(spark, sf_dir), X.rubric_entries(spark, sf_dir))


@query(f"WITH {X.ANALYSES}, {X.ENTRIES}, {_COVER} SELECT doc_id, turn, round(coverage, 6) AS coverage, array_to_string(issues, '; ') AS issues FROM covered")
def coverage_score(spark, sf_dir):
    rows = X.chat_analyses(spark, sf_dir).join(F.broadcast(X.rubric_entries(spark, sf_dir)), "category", "left")  # a rubric
    score, issues = quality.coverage(F.col("response"), F.col("scoring_reasoning"), F.coalesce("definition", F.lit("")), F.coalesce("indicators", F.array().cast("array<string>")))
    return rows.select("doc_id", "turn", r6(score).alias("coverage"), F.array_join(issues, "; ").alias("issues"))


@query(f"{_ASSESS} SELECT doc_id, turn, category, round(readability, 6) AS readability, round(coherence, 6) AS coherence, round(coverage, 6) AS coverage, round(composite, 6) AS composite, round(composite, 9) >= 0.75 AS passed FROM assessed")
def composite_quality(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", "turn", "category", *[r6(c).alias(c) for c in ("readability", "coherence", "coverage", "composite")], "passed")


@query(f"""{_ASSESS} SELECT doc_id, round(avg(composite), 6) AS overall_composite, round(avg(CASE WHEN round(composite, 9) >= 0.75 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
  coalesce(string_agg(category, ',' ORDER BY category) FILTER (round(composite, 9) < 0.75), '') AS failed, CAST(sum(len(issues)) AS BIGINT) AS total_issues FROM assessed GROUP BY doc_id""")
def quality_report(spark, sf_dir):
    return quality.report(_assessed(spark, sf_dir)).select("doc_id", r6("overall_composite").alias("overall_composite"), r6("pass_rate").alias("pass_rate"), F.array_join("failed_categories", ",").alias("failed"), "total_issues")


@query("""WITH e AS (SELECT event_id, event_id % 7 AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 'right' AS category, CASE WHEN kind IN (0, 1) THEN greatest(0, least(5, k)) WHEN kind = 4 THEN 2 WHEN kind = 5 THEN 1 ELSE 0 END AS score,
  CASE WHEN kind = 6 THEN '' ELSE 's' END AS scoring_reasoning, CASE WHEN kind = 6 THEN '' ELSE '1,2,3' END AS pages,
  CASE WHEN kind IN (0, 4, 5) THEN 6 WHEN kind = 6 THEN 2 ELSE 5 END AS n_right, CASE WHEN kind IN (0, 4, 5) THEN 0 WHEN kind = 6 THEN 4 ELSE 1 END AS n_issues FROM e""")
def schema_repair(spark, sf_dir):
    rows = quality.repair(X.loose_entries(spark, sf_dir))
    return rows.select("event_id", "repaired.category", "repaired.score", "repaired.scoring_reasoning", F.array_join("repaired.response_page_citations", ",").alias("pages"), F.round(F.col("compliance") * 6).cast("int").alias("n_right"), F.size("schema_issues").alias("n_issues"))


@query(f"WITH {X.ANALYSES} SELECT doc_id, turn, length(response) >= 50 AND length(scoring_reasoning) >= 30 AND score BETWEEN 0 AND 5 AS acceptable FROM analyses")
def acceptable_replies(spark, sf_dir):
    return X.chat_analyses(spark, sf_dir).select("doc_id", "turn", quality.acceptable(F.col("response"), F.col("score"), F.col("scoring_reasoning")).alias("acceptable"))


_AGAIN = X.ANALYSES.replace("analyses AS (", "made_ AS (") + f""", {X.ENTRIES}, analyses AS (SELECT doc_id, turn * 10 + i AS turn, category, response || repeat(' ' || coalesce(definition, ''), i) AS response, scoring_reasoning || repeat(' ' || coalesce(definition, ''), i) AS scoring_reasoning, score
  FROM (SELECT made_.*, definition FROM made_ LEFT JOIN entries USING (category)) CROSS JOIN range(4) r(i))"""
_ROUNDS = _ASSESS.replace(f"{X.ANALYSES}, {X.ENTRIES}", _AGAIN)


@query(f"""{_ROUNDS}, tried AS (SELECT doc_id, turn // 10 AS turn, turn % 10 AS i, category, composite, round(composite, 9) >= 0.75 AS passed FROM assessed)
SELECT doc_id, CAST(turn AS INTEGER) AS turn, category, round(composite, 6) AS composite, passed FROM tried QUALIFY row_number() OVER (PARTITION BY doc_id, turn ORDER BY passed DESC, CASE WHEN passed THEN i ELSE -i END) = 1""")
def remediation_loop(spark, sf_dir):
    """Failed analyses get a longer reply in each round."""
    entries = X.rubric_entries(spark, sf_dir)

    def again(rows: DataFrame) -> DataFrame:
        known = rows.join(F.broadcast(entries.select("category", "definition")), "category", "left")  # a rubric
        longer = known.withColumns({"response": F.concat("response", F.lit(" "), F.coalesce("definition", F.lit(""))), "scoring_reasoning": F.concat("scoring_reasoning", F.lit(" "), F.coalesce("definition", F.lit("")))})
        base = X.chat_analyses(spark, sf_dir).columns
        return quality.assess(longer.select(*base), entries)

    found = remediate(_assessed(spark, sf_dir), again)
    return found.select("doc_id", "turn", "category", r6("composite").alias("composite"), "passed")


# Rubric texts ---------------------------------------------------------------------------------------------------------------

_BUL = lambda x: f"array_to_string(list_transform({x}, lambda i: '- ' || i), chr(10))"


@query(f"""WITH {X.ENTRIES}, kb AS (
  SELECT ordinal * 2 AS ord, 'Category: ' || category || chr(10) || chr(10) || 'Definition: ' || definition || CASE WHEN len(indicators) > 0 THEN chr(10) || chr(10) || 'Recommended Indicators:' || chr(10) || {_BUL('indicators')} ELSE '' END AS content, category, 'definition' AS type FROM entries
  UNION ALL SELECT ordinal * 2 + 1, 'Scoring Rubric for ' || category || ':' || chr(10) || chr(10) || array_to_string(scoring_definitions, chr(10)), category, 'scoring_rubric' FROM entries WHERE len(scoring_definitions) > 0)
SELECT CAST(ord AS BIGINT) AS ord, content, category, type FROM kb""")
def kb_build(spark, sf_dir):
    return rubric.knowledge_base(X.rubric_entries(spark, sf_dir))


@query(f"""WITH {X.ENTRIES} SELECT category, '## Sub-Element: ' || category || chr(10) || chr(10) || '### Definition' || chr(10) || definition
  || CASE WHEN len(indicators) > 0 THEN chr(10) || chr(10) || '### Recommended Indicators' || chr(10) || {_BUL('indicators')} ELSE '' END
  || CASE WHEN len(scoring_definitions) > 0 THEN chr(10) || chr(10) || '### Scoring Criteria' || chr(10) || {_BUL('scoring_definitions')} ELSE '' END AS context FROM entries""")
def prompt_context(spark, sf_dir):
    return rubric.prompt_context(X.rubric_entries(spark, sf_dir))


# Files: validation and export -----------------------------------------------------------------------------------------------

@query(f"WITH {X.FACTS}, plans AS (SELECT DISTINCT country, year FROM facts) SELECT country, year, dim.category FROM plans CROSS JOIN dim ANTI JOIN facts ON plans.country = facts.country AND plans.year = facts.year AND dim.category = facts.category")
def validate_required(spark, sf_dir):
    return validate.missing_categories(X.plan_facts(spark, sf_dir), ("country", "year"))


@query(f"WITH {X.FACTS} SELECT country, year, category, count(*) AS n_rows FROM facts GROUP BY ALL HAVING count(*) > 1")
def validate_duplicates(spark, sf_dir):
    return validate.duplicate_categories(X.plan_facts(spark, sf_dir), ("country", "year"))


@query(f"""WITH {X.FACTS}, per AS (SELECT country || '_' || year || '.json' AS filename, category, count(*) AS c, count(*) FILTER (l_orderkey % 7 = 0) AS gaps FROM facts GROUP BY ALL),
r AS (SELECT filename, CAST(sum(c) AS INTEGER) AS total_categories, CAST(76 - count(*) AS INTEGER) AS n_missing, count(*) FILTER (c > 1) AS d, CAST(sum(gaps) AS INTEGER) AS n_gaps, coalesce(string_agg(category, '|' ORDER BY category) FILTER (c > 1), '') AS duplicates FROM per GROUP BY filename)
SELECT filename, total_categories, n_missing, 0 AS n_extra, duplicates, n_gaps, '' AS errors, n_missing = 0 AND d = 0 AS is_valid FROM r
UNION ALL VALUES ('bad.json', 0, 0, 0, '', 0, 'JSON parsing error', false), ('object.json', 0, 0, 0, '', 0, 'JSON root is not a list/array', false),
  ('odd.json', 5, 75, 1, 'Health', 3, 'Entry 0 is not a dictionary|Entry 1 missing ''category'' field', false)""")
def validate_report(spark, sf_dir):
    found = validate.file_report(X.analysis_files(spark, sf_dir))
    return found.select("filename", "total_categories", F.size("missing_categories").alias("n_missing"), F.size("extra_categories").alias("n_extra"), F.array_join("duplicate_categories", "|").alias("duplicates"), F.size("categories_missing_fields").alias("n_gaps"), F.array_join("errors", "|").alias("errors"), "is_valid")


_EXPORT = f"""WITH {X.FACTS} SELECT replace(country, '_', ' ') AS country, year, category AS "Sub-Element", CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'text' END AS response, '' AS response_page_citations, CAST(CAST(score AS INTEGER) AS VARCHAR) AS score, 'why' AS reasoning, '' AS scoring_reasoning_page_citations FROM facts"""
_ODD = "SELECT 'odd', 'Unknown', c, '', '', s, '', '' FROM (VALUES ('', ''), ('', '2'), ('Health', ''), ('Else', ''), ('Health', '')) t(c, s)"


@query(f"{_EXPORT} UNION ALL {_ODD}")
def export_rows(spark, sf_dir):
    return sinks.export_rows(A.entries(X.analysis_files(spark, sf_dir)))


_CHOSEN = ["NATION 3", "NATION 7", "NATION 21", "Kenya"]


@query(f"SELECT * FROM ({_EXPORT}) WHERE country IN ('NATION 3', 'NATION 7', 'NATION 21', 'Kenya')")
def export_filtered(spark, sf_dir):
    return sinks.only(sinks.export_rows(A.entries(X.analysis_files(spark, sf_dir))), _CHOSEN)


@query("SELECT * FROM (VALUES ('bad.json', 'JSON parsing error'), ('object.json', 'JSON root is not a list/array')) t(filename, error)")
def unreadable_files(spark, sf_dir):
    return A.unreadable(X.analysis_files(spark, sf_dir))

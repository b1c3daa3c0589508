"""Evidence pages of assessments: shared entities, similar windows, votes, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as T
from ..settings import Attribution

KEYS = ("doc_id", "category", "field")
FIELDS = ("response", "scoring_reasoning")


def fields(analyses: DataFrame) -> DataFrame:
    """One row per text of an analysis: doc_id, category, field, text; blank ones go."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    rows = analyses.select("doc_id", "category", F.explode(both).alias("x")).select("doc_id", "category", "x.field", "x.text")
    return rows.filter(~T.is_blank(F.col("text")))


def entity_pages(texts: DataFrame, pages: DataFrame, keys: tuple = KEYS, settings: Attribution | None = None) -> DataFrame:
    """keys, page_number: pages that share an entity with the text. Entities of pages are taken once, for all texts.

    With doc_id as the only key pages stay whole: each meets the set of its document's texts. (The filter allows null, or Spark would
    look for entities twice, once only to see that they are not null.)
    """
    s = settings or Attribution()
    all_ = lambda c: E.entities(c, s.first_year, s.last_year)
    if tuple(keys) == ("doc_id",):
        own = texts.select("doc_id", all_(F.col("text")).alias("own")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
        return pages.select("doc_id", "page_number", all_(F.col("text")).alias("there")).join(own, "doc_id").filter(F.coalesce(F.arrays_overlap("there", "own"), F.lit(False))).select("doc_id", "page_number").distinct()
    of = lambda c: F.explode(all_(c)).alias("entity")
    own = texts.select(*keys, of(F.col("text"))).distinct()
    there = pages.select("doc_id", "page_number", of(F.col("text")))
    return own.join(there, ["doc_id", "entity"]).select(*keys, "page_number").distinct()


def temperatures(samples: int = 3, low: float = 0.8, high: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.lit(low) + F.lit(high - low) * i / F.lit(max(samples - 1, 1)))


def majority(votes: DataFrame, keys: tuple, least: int = 2) -> DataFrame:
    """votes: keys, reply. Groups with so many replies that mean yes."""
    return votes.groupBy(*keys).agg(F.count_if(T.says_yes(F.col("reply"))).alias("yes"), F.count(F.lit(1)).alias("n_votes")).withColumn("confirmed", F.col("yes") >= least)


def combine(a: DataFrame, b: DataFrame, c: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """keys, page_number, confidence, methods. a, b, c: keys, page_number, from entities, similarity and votes.

    High: in all three. If there is none, medium: in two, of the pair that has most pages in common (AB before AC before BC). If
    there is none, low: similar ones. Tiers are found by sums over the group, without collecting sets.
    """
    tag = lambda df, m: df.select(*keys, "page_number", F.lit(m).alias("m"))
    marked = tag(a, "A").union(tag(b, "B")).union(tag(c, "C")).groupBy(*keys, "page_number").agg(*[F.bool_or(F.col("m") == m).alias(m) for m in "ABC"])
    group = Window.partitionBy(*keys)
    n = lambda cond: F.sum(cond.cast("int")).over(group)
    inside = {p: F.col(p[0]) & F.col(p[1]) for p in ("AB", "AC", "BC")}
    all_ = F.col("A") & F.col("B") & F.col("C")
    x = marked.withColumns({"n3": n(all_), "n1": n(F.col("B"))} | {f"n{p}": n(v) for p, v in inside.items()})
    most = F.greatest("nAB", "nAC", "nBC")
    pair = F.when(most == 0, None).when(F.col("nAB") == most, "AB").when(F.col("nAC") == most, "AC").otherwise("BC")
    x = x.withColumn("pair", pair)
    chosen = F.lit(False)
    for p, v in inside.items():
        chosen = chosen | ((F.col("pair") == p) & v)
    level = F.when((F.col("n3") > 0) & all_, "high").when((F.col("n3") == 0) & F.col("pair").isNotNull() & chosen, "medium").when((F.col("n3") == 0) & F.col("pair").isNull() & F.col("B"), "low")
    methods = F.when(level == "high", F.array(*map(F.lit, "ABC"))).when(level == "medium", F.split(F.col("pair"), "")).otherwise(F.array(F.lit("B")))
    return x.withColumns({"confidence": level, "methods": methods}).filter("confidence IS NOT NULL").select(*keys, "page_number", "confidence", "methods")


def high_confidence(refs: DataFrame, keys: tuple = KEYS) -> DataFrame:
    return refs.filter("confidence = 'high'").groupBy(*keys).agg(F.sort_array(F.collect_set("page_number")).alias("pages"))


def cite(analyses: DataFrame, refs: DataFrame) -> DataFrame:
    """Analyses with the sorted pages of both their fields; what they had before stays where nothing was looked up."""
    wide = refs.groupBy("doc_id", "category").agg(*[F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("page_number")))).alias(f"new_{f}") for f in FIELDS])
    rows = analyses.join(wide, ["doc_id", "category"], "left")
    return rows.withColumns({f"{f}_page_citations": F.coalesce(f"new_{f}", F.array().cast("array<int>")) for f in FIELDS}).drop(*[f"new_{f}" for f in FIELDS])


def vote_prompt(assessment: Column, page: Column, page_number: Column) -> Column:
    """Asks whether a page is a source of an assessment."""
    return F.concat(
        F.lit("Decide whether one page of a policy document was a source of an assessment.\n\n## Assessment\n"), T.truncated(assessment, T.ASSESSMENT_LIMIT), F.lit("\n\n## Page "), page_number.cast("string"), F.lit("\n"), T.truncated(page, T.PAGE_LIMIT),
        F.lit("\n\n## Question\nDoes this page hold information, quoted or paraphrased, that the assessment uses? Answer YES or NO only."),
    )


def voted_pages(texts: DataFrame, pages: DataFrame, similar: DataFrame, generator, keys: tuple = KEYS, settings: Attribution | None = None) -> DataFrame:
    """keys, page_number: candidate pages (at or above the percentile of similarity, not blank) that a majority of replies confirms."""
    from .generation import ask
    from .similarity import prefiltered_pages

    s = settings or Attribution()
    near = prefiltered_pages(similar, keys, s.prefilter_percentile).select(*keys, "page_number")
    rows = near.join(pages.select("doc_id", "page_number", F.col("text").alias("page")), ["doc_id", "page_number"]).filter(~T.is_blank(F.col("page"))).join(texts, list(keys))
    prompts = rows.select(*keys, "page_number", vote_prompt(F.col("text"), F.col("page"), F.col("page_number")).alias("prompt"), F.explode(temperatures(s.samples, s.temperature_low, s.temperature_high)).alias("temperature"))
    return majority(ask(prompts, generator, s.top_p), (*keys, "page_number"), s.majority).filter("confirmed").select(*keys, "page_number")


def extract(analyses: DataFrame, pages: DataFrame, embedder=None, generator=None, settings: Attribution | None = None) -> DataFrame:
    """Evidence pages of all texts of all analyses of all documents, in one plan."""
    from ..common import staged
    from .generation import embed
    from .similarity import page_similarity, similar_pages

    s = settings or Attribution()
    texts = staged(fields(analyses), "cite-texts")
    a = entity_pages(texts, pages, settings=s)
    none = texts.select(*KEYS, F.lit(0).alias("page_number")).limit(0)
    if embedder is None:
        return combine(a, none, none)
    windows = lambda c: F.explode(T.token_windows(c, s.window_size, s.window_stride)).alias("window")
    q = texts.select(*KEYS, windows(F.col("text")))
    p = pages.select("doc_id", "page_number", F.explode_outer(T.token_windows(F.col("text"), s.window_size, s.window_stride)).alias("window"))
    p = staged(embed(p, embedder, "window", s.embed_batch), "cite-pages")  # once for all texts
    q = embed(q, embedder, "window", s.embed_batch).withColumn("query", F.struct("category", "field"))
    similar = page_similarity(q, p).select("doc_id", "query.category", "query.field", "page_number", "similarity")
    similar = staged(similar, "cite-similar")
    b = similar_pages(similar, KEYS).select(*KEYS, "page_number")
    c = none if generator is None else voted_pages(texts, pages, similar, generator, settings=s)
    return combine(a, b, c)

"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space (space, \\t \\n \\v \\f \\r); null counts as empty.
The row with the most code points in its original text stays, then the smallest doc_id (null ids come last).

Each level looks only at what survives the level before: lengths are grouped alone; prefixes are grouped only of texts whose length
repeats; the full hash is taken only of texts whose length and prefix repeat. ``annotate`` returns the full hash of every text, so
it takes lengths, prefixes and hashes in one pass over the texts and refines narrow rows; ``deduplicate`` hashes nothing else than survivors. All of it is built-in
expressions. Groups are reduced by partial aggregation, so that a group with a third of all rows costs no more
than one row per task in the shuffle.

Defined cases: null or empty texts are equal to each other; rows that agree in doc_id and text are one document
(``annotate`` marks all of them alike, ``deduplicate`` keeps one); a very long text is hashed whole; an empty table gives an empty table; further
columns pass through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, squeezed, staged, text_of

#: Characters of the normalised text under the prefix hash.
PREFIX = 64
#: Groups (of some 100 bytes) that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 100_000


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), F.char_length(text_of(text)).alias("chars"), squeezed(text_of(text)).alias("norm"))
    return rows.withColumn("size", F.octet_length("norm"))


def _prefix(norm: Column, prefix: int) -> Column:
    return F.xxhash64(F.substring(norm, 1, prefix))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), "exact-alive")


def _groups(hashed: DataFrame) -> DataFrame:
    """hashed: id, chars, sha of the survivors. One row per group of two or more: sha, keep_id, group_size, n_same (rows tied with the one that stays)."""
    ties = hashed.groupBy("sha", "chars", "id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("id", "n"), F.struct("chars", F.bitwise_not("id"))).alias("best")
    found = ties.groupBy("sha").agg(best, F.sum("n").alias("group_size")).filter("group_size > 1")
    return staged(found.select("sha", F.col("best.id").alias("keep_id"), "group_size", F.col("best.n").alias("n_same")), "exact-groups")


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, doc_id, text).select("id", "chars", "size", _prefix(F.col("norm"), prefix).alias("pre"), F.sha2("norm", 256).alias("sha"))
    rows = staged(rows, "exact-rows")
    left = rows.join(_bounded(_repeated(rows, "size")), "size", "left_semi")
    left = left.join(_bounded(_repeated(left, "size", "pre")), ["size", "pre"], "left_semi")
    found = _bounded(_groups(left.select("id", "chars", "sha")).select("sha", "keep_id", "group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select("id", "sha").join(found, "sha", "left").select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """size, pre: lengths and prefix hashes that more than one text has."""
    rows = _rows(docs, doc_id, text)
    left = rows.join(_bounded(_repeated(rows, "size")), "size", "left_semi")
    return _repeated(left.withColumn("pre", _prefix(F.col("norm"), prefix)), "size", "pre")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of docs that stay, with all of docs' columns."""
    sha, keep, size, same, long_, pre, alive = fresh(docs, "__sha", "__keep", "__size", "__same", "__long", "__pre", "__alive")
    some = survivors(docs, doc_id, text, prefix)
    rows = _rows(docs, doc_id, text).withColumn("pre", _prefix(F.col("norm"), prefix))
    table = _groups(rows.join(_bounded(some), ["size", "pre"], "left_semi").select("id", "chars", F.sha2("norm", 256).alias("sha")))
    norm = squeezed(text_of(text))
    left = docs.withColumns({long_: F.octet_length(norm), pre: _prefix(norm, prefix)})
    left = left.join(_bounded(some.select(F.col("size").alias(long_), F.col("pre").alias(pre), F.lit(True).alias(alive))), [long_, pre], "left")
    left = left.withColumn(sha, F.when(F.col(alive), F.sha2(norm, 256)))  # null for all others
    left = left.join(_bounded(table.toDF(sha, keep, size, same)), sha, "left").filter(F.col(size).isNull() | F.col(doc_id).eqNullSafe(F.col(keep)))
    if small(table.filter("n_same > 1"), 0):
        return left.select(*docs.columns)
    tied = left.filter(F.col(same) > 1).dropDuplicates([sha, doc_id])
    return left.filter(F.coalesce(F.col(same), F.lit(1)) == 1).unionByName(tied).select(*docs.columns)

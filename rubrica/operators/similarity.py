"""Similarity of assessments and pages by window vectors; top-k retrieval by vectors or by terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded, staged
from ..functions import text as T

#: Rows of a matrix.
BLOCK = 1024
#: Numbers of one side that meet in a task at most, parts of the right and the left side below that, rows and columns of a product.
NUMBERS, RIGHT_PARTS, LEFT_PARTS, ROWS, COLUMNS = 1 << 23, 6, 8, 256, 2048


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def _met(left: DataFrame, right: DataFrame, group: tuple, of: Callable, schema: str) -> DataFrame:
    """of(part of left, part of right) for every pair of blocks of at most BLOCK rows that have the group columns in common.

    Most groups are one block on either side. Rows of null vectors take no part.
    """
    count = lambda df, n: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    left, right = (df.filter("vector IS NOT NULL") for df in (left, right))
    blocks = bounded(staged(count(left, "nl").join(count(right, "nr"), list(group)), "blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c not in group]), F.col(n)).cast("int")
    a = left.join(blocks, list(group)).withColumn("bl", own(left, "nl")).withColumn("br", each("nr")).drop("nl", "nr")
    b = right.join(blocks, list(group)).withColumn("br", own(right, "nr")).withColumn("bl", each("nl")).drop("nl", "nr")
    a, b = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (a, b))
    return a.groupBy(*group, "bl", "br").cogroup(b.groupBy(*group, "bl", "br")).applyInPandas(lambda x, y: of(x, y), schema)


def _grid(left: DataFrame, right: DataFrame, of: Callable, schema: str) -> DataFrame:
    """of(left rows, right rows), two Arrow tables, gives batches for every pair of parts of two whole sides.

    The number of parts does not grow with the rows until a part has NUMBERS, so neither does the number of times a row
    is sent. Rows are dealt by their place in a staged table: equal ones go apart, and a task that is repeated gets the same ones.
    Rows of null vectors take no part.
    """
    left, right = (staged(df.filter("vector IS NOT NULL"), "side") for df in (left, right))
    n, m = left.count(), right.count()
    if not n or not m:
        return left.sparkSession.createDataFrame([], schema)
    most = max(NUMBERS // max(right.select(F.size("vector")).first()[0], 1), 1)
    parts = lambda rows, least: max(ceil(rows / most), min(least, ceil(rows / BLOCK)))
    nl, nr = parts(n, LEFT_PARTS), parts(m, RIGHT_PARTS)
    dealt = lambda k: F.pmod(F.monotonically_increasing_id(), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.withColumn("l_", dealt(nl)).withColumn("r_", each(nr))
    b = right.withColumn("r_", dealt(nr)).withColumn("l_", each(nl))
    a, b = (df.withColumn("pair_", (F.col("l_") * nr + F.col("r_")).cast("int")).drop("l_", "r_").withColumn("left_", F.lit(side)) for df, side in ((a, True), (b, False)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            rows = pa.Table.from_batches(got)
            got.clear()
            own = rows["left_"]
            yield from of(rows.filter(own), rows.filter(pa.compute.invert(own)))

    return a.unionByName(b, allowMissingColumns=True).repartitionById(nl * nr, "pair_").mapInArrow(met, schema)


def _numbers(rows: pa.Table) -> np.ndarray:
    return rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _highest_of_pages(q: pa.Table, p: pa.Table) -> Iterator[pa.RecordBatch]:
    """q: q_, vector. p: page_number, vector. The highest product of every q_ with every page; a q_ may come more than once."""
    if not len(q) or not len(p):
        return
    coded = p["page_number"].combine_chunks().dictionary_encode("encode")
    at = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    at, there, numbers = at[order], _numbers(p)[order], coded.dictionary
    asked = q["q_"].to_numpy()
    order = np.argsort(asked, kind="stable")
    asked, x = asked[order], _numbers(q)[order]
    step = max(1, min(ROWS, (1 << 22) // len(numbers)))
    for i in range(0, len(x), step):
        ids, first = np.unique(asked[i : i + step], return_index=True)
        best = np.full((len(ids), len(numbers)), -np.inf)
        for j in range(0, len(there), COLUMNS):
            own = at[j : j + COLUMNS]
            start = np.flatnonzero(np.diff(own, prepend=-1))
            product = np.maximum.reduceat(x[i : i + step] @ there[j : j + COLUMNS].T, start, axis=1)
            best[:, own[start]] = np.maximum(best[:, own[start]], np.maximum.reduceat(product, first, axis=0))
        best = best.round(12)  # so that equal vectors score alike wherever they stand
        page = numbers.take(pa.array(np.tile(np.arange(len(numbers)), len(ids))))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(numbers))), page, pa.array(best.ravel())], ["q_", "page_number", "similarity"])


def _nearest(x: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in d and products of the k greatest products of each row of x; of equals the first. Once a row has k, only greater ones are looked at."""
    start = max(k, 256)
    score = (x @ d[:start].T).round(12)
    at = np.argsort(-score, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(score, at, 1)
    row = np.arange(len(x))
    for j in range(start, len(d), COLUMNS):
        more = x @ d[j : j + COLUMNS].T
        least = np.where(np.isnan(score[:, -1]), -np.inf, score[:, -1])
        hit = np.flatnonzero(more > (least + 1e-13)[:, None])
        if not len(hit):
            continue
        r, c = np.divmod(hit, more.shape[1])
        r, c, s = np.concatenate([np.repeat(row, k), r]), np.concatenate([at.ravel(), c + j]), np.concatenate([score.ravel(), more.ravel()[hit].round(12)])
        order = np.lexsort((c, -s, r))
        pick = order[np.searchsorted(r[order], row)[:, None] + np.arange(k)]
        at, score = c[pick], s[pick]
    return at, score


def page_similarity(queries: DataFrame, pages: DataFrame, group: tuple = ("doc_id",)) -> DataFrame:
    """Highest dot product of any query window with any window of a page.

    queries: group columns, query, vector. pages: group columns, page_number, vector (null for a blank page: similarity 0).
    Windows meet within a group only, as matrices; without group columns parts of both sides meet in a grid.
    """
    key = group or ("all_",)
    if not group:
        queries, pages = queries.withColumn("all_", F.lit(0)), pages.withColumn("all_", F.lit(0))
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *pages.schema.fields]}
    asked = queries.groupBy(*key, "query").agg(F.count("vector").alias("n_")).drop("n_")
    numbered = queries.select(*key, F.xxhash64("query").alias("q_"), "vector")

    def highest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*key, "q_", "page_number", "similarity"])
        order = np.argsort(q.q_.to_numpy(), kind="stable")
        ids, first = np.unique(q.q_.to_numpy()[order], return_index=True)
        rows = np.maximum.reduceat(_matrix(q.vector)[order] @ _matrix(p.vector).T, first, axis=0)
        order = np.argsort(p.page_number.to_numpy(), kind="stable")
        numbers, first = np.unique(p.page_number.to_numpy()[order], return_index=True)
        best = np.maximum.reduceat(rows[:, order], first, axis=1).round(12)  # so that equal vectors score alike wherever they stand
        out = pd.DataFrame({"q_": np.repeat(ids, len(numbers)), "page_number": np.tile(numbers, len(ids)), "similarity": best.ravel()})
        for c in key:
            out[c] = p[c].iloc[0]
        return out[[*key, "q_", "page_number", "similarity"]]

    schema = ", ".join([f"`{c}` {kind[c]}" for c in key] + ["q_ long", f"page_number {kind['page_number']}", "similarity double"])
    if group:
        found = _met(pages.select(*key, "page_number", "vector"), numbered, key, highest, schema)
    else:
        found = _grid(numbered.select("q_", "vector"), pages.select("page_number", "vector"), _highest_of_pages, f"q_ long, page_number {kind['page_number']}, similarity double").select(F.lit(0).alias("all_"), "q_", "page_number", "similarity")
    blank = pages.filter("vector IS NULL").select(*key, "page_number").join(asked.withColumn("q_", F.xxhash64("query")).drop("query"), list(key))
    found = found.union(blank.select(*key, "q_", "page_number", F.lit(0.0))).groupBy(*key, "q_", "page_number").agg(F.max("similarity").alias("similarity"))
    return found.join(asked.withColumn("q_", F.xxhash64("query")), [*key, "q_"]).select(*group, "query", "page_number", "similarity")


def adaptive_threshold(similar: DataFrame, keys: tuple) -> DataFrame:
    """keys, threshold: half way between the means of the two clusters of each group's similarities.

    The best split in two on a line is one of the cuts of the sorted values, so running sums find it: the cut with the greatest
    s1²/n1 + s2²/n2, the first of equal ones. Groups of fewer than three have their median, equal values that value.
    """
    order = Window.partitionBy(*keys).orderBy("similarity", "page_number")
    run, all_ = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    x = similar.select(*keys, "similarity", F.row_number().over(order).alias("n1"), F.sum("similarity").over(run).alias("s1"), F.count(F.lit(1)).over(all_).alias("n"), F.sum("similarity").over(all_).alias("s"))
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    cut = F.when(n2 > 0, F.col("s1") * F.col("s1") / F.col("n1") + s2 * s2 / n2)
    middle = F.when(n2 > 0, (F.col("s1") / F.col("n1") + s2 / n2) / 2)
    found = x.withColumns({"cut": cut, "middle": middle}).groupBy(*keys).agg(
        F.max_by("middle", F.struct(F.col("cut"), (-F.col("n1")).alias("first"))).alias("best"), F.median("similarity").alias("median"), F.min("similarity").alias("low"), F.max("similarity").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return found.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("n") < 3, F.col("median")).otherwise(F.col("best")).alias("threshold"))


def similar_pages(similar: DataFrame, keys: tuple) -> DataFrame:
    """Pages at or above their group's adaptive threshold."""
    return similar.join(adaptive_threshold(similar, keys), list(keys)).filter(F.col("similarity") >= F.col("threshold"))


def prefiltered_pages(similar: DataFrame, keys: tuple, percentile: float = 0.25) -> DataFrame:
    """Pages at or above a percentile of their group (linear interpolation)."""
    level = similar.groupBy(*keys).agg(F.percentile("similarity", F.lit(percentile)).alias("level"))
    return similar.join(level, list(keys)).filter(F.col("similarity") >= F.col("level"))


def top_k_by_vector(queries: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """queries: query, vector. documents: ord, vector. The k nearest by dot product; of equals the later first.

    Parts of both sides meet in a grid; each pair keeps its k best, and a window merges them.
    """
    kind = queries.schema["query"].dataType.simpleString()

    def best(q: pa.Table, d: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(q) or not len(d):
            return
        d = d.sort_by([("ord", "descending")])
        x, there, ord_, asked = _numbers(q), _numbers(d), d["ord"].to_numpy(), q["query"].combine_chunks()
        for i in range(0, len(x), ROWS):
            at, score = _nearest(x[i : i + ROWS], there, k)
            who = asked.take(pa.array(np.repeat(np.arange(i, i + len(at)), at.shape[1])))
            yield pa.RecordBatch.from_arrays([who, pa.array(ord_[at.ravel()]), pa.array(score.ravel())], ["query", "ord", "similarity"])

    found = _grid(queries.select("query", "vector"), documents.select(F.col("ord").cast("long"), "vector"), best, f"query {kind}, ord long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.desc("ord"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_by_terms(queries: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """queries: query, text. documents: ord, content. The k documents that share most distinct lower-case terms; of equals the earlier
    first, so that documents which share none fill up.

    Terms meet in an equi-join; only documents that share a term are counted, and the first k of all fill up the rest.
    """
    terms = lambda c: F.explode(F.array_distinct(T.tokens(F.lower(c)))).alias("term")
    q, d = queries.select("query", terms(F.col("text"))), documents.select("ord", terms(F.col("content")))
    shared = q.join(bounded(d), "term").groupBy("query", "ord").agg(F.count(F.lit(1)).alias("overlap"))
    first = documents.select("ord").orderBy("ord").limit(k)  # k rows
    fill = queries.select("query").crossJoin(F.broadcast(first)).select("query", "ord", F.lit(0).cast("long").alias("overlap"))
    all_ = shared.union(fill).groupBy("query", "ord").agg(F.max("overlap").alias("overlap"))
    order = Window.partitionBy("query").orderBy(F.desc("overlap"), F.asc("ord"))
    return all_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """By vectors if both sides have them, else by terms."""
    if "vector" in queries.columns and "vector" in documents.columns:
        return top_k_by_vector(queries, documents, k)
    return top_k_by_terms(queries, documents, k)

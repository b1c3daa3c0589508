"""Exact top-k search over quantised vectors by exhaustive term-at-a-time accumulation.

Every component x becomes floor(256 * x) (x as double). Vectors are packed into blocks: queries as sparse rows of
(dimension, weight), candidates as one posting list per dimension. In a pair of blocks, each query takes its terms one
at a time and scatters weight * posting into a dense score array over the block; a partition selection keeps the k best,
and a window merges the blocks' winners. Blocks of candidates meet blocks of queries through an equi-join on the query
block and a shard of candidates, so a task holds one block of either side and a partition one shard, whatever the table's size.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part; vectors of different
length meet on their common dimensions; rows that share a vec_id: the candidates with the query's own vec_id are left
out, and the query with the smallest quantised vector stands for its id; ties go to the smaller vec_id; null ids take no part;
an empty table gives an empty table; further columns are ignored. There are no texts here.
Scores are 64-bit integers, exact while they fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

#: Vectors in a block of candidates, and in a block of queries; blocks of candidates in a shard.
CANDIDATES, QUERIES, SHARD = 8192, 1024, 16


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, q array<bigint> of the rows that take part."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
    clipped = lambda v: F.least(F.greatest(F.floor(v * float(scale)), F.lit(-(2**62))), F.lit(2**62))
    return rows.select("vec_id", F.transform("x", clipped).alias("q"))


def _pack(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), limit):
            part = pdf.iloc[at : at + limit]
            width = max(map(len, part.q))
            m = np.zeros((width, len(part)), np.int64)
            for j, q in enumerate(part.q):
                m[: len(q), j] = q
            yield pd.DataFrame({"ids": [part.vec_id.to_numpy(np.int64).tobytes()], "width": [width], "m": [m.tobytes()]})


def blocks(rows: DataFrame, limit: int) -> DataFrame:
    return rows.mapInPandas(lambda it: _pack(it, limit), "ids binary, width int, m binary")


def top_of_block(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def accumulate(query: np.ndarray, postings: np.ndarray) -> np.ndarray:
    score = np.zeros(postings.shape[1], np.int64)
    for d in np.flatnonzero(query[: len(postings)]):
        score += query[d] * postings[d]
    return score


def _score(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            cid, qid = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
            c, q = np.frombuffer(r.m, np.int64).reshape(r.width, -1), np.frombuffer(r.q_m, np.int64).reshape(r.q_width, -1)
            out = []
            for j, own in enumerate(qid):
                score = accumulate(q[:, j], c)
                others = np.flatnonzero(cid != own)
                best = others[top_of_block(cid[others], score[others], k)]
                out.append((np.full(len(best), own), cid[best], score[best]))
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries: vec_id, q. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    one = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    one = staged(one, "topk-queries")
    n, shards = -(-one.count() // QUERIES), max(1, -(-vectors.count() // (CANDIDATES * SHARD)))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = one.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    asked = dealt.groupBy("qb").applyInPandas(lambda pdf: next(_pack(iter([pdf]), len(pdf))).assign(qb=pdf.qb.iloc[0]), "ids binary, width int, m binary, qb long")
    asked = staged(asked.toDF("q_ids", "q_width", "q_m", "qb"), "topk-blocks")
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    meet = blocks(vectors, CANDIDATES).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards).cast("long"))).withColumn("qb", every(n))
    best = meet.join(asked.withColumn("shard", every(shards)), ["qb", "shard"]).select("ids", "width", "m", "q_ids", "q_width", "q_m").mapInPandas(lambda it: _score(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

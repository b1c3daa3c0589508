"""Token counts by a map-side two-tier lookup.

A first pass over all texts finds the frequent pre-token groups (what stands between spaces): each task keeps a bounded
mergeable summary of its own, and the summaries, never the pre-tokens, are merged in a tree. Their lengths in
tokens become one compact table of at most ``FREQUENT`` entries of at most 32 characters, which is broadcast. In the
second pass a text's pieces are looked up there; misses are encoded in the worker, which keeps a bounded number of them.
No pre-token is ever shuffled, and counts do not depend on what the table holds.

Defined cases: a null text has 0 bytes and 0 tokens, as an empty one; repeated rows give repeated results; a very long text is counted whole, in one task;
pieces that tie in frequency only decide what is kept, never a count; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept, coder
from .common import ship, take_over, text_of, tidied

FREQUENT = 65_536
#: Summaries that one task merges.
FAN_IN = 64
_kept: dict[tuple, tuple] = {}


def prune(counts: Counter, limit: int) -> Counter:
    """A mergeable summary: the largest counts, less the largest one dropped."""
    if len(counts) <= limit:
        return counts
    top = counts.most_common(limit + 1)
    off = top[-1][1]
    return Counter({k: v - off for k, v in top[:-1] if v > off})


def _pack(counts: Counter) -> bytes:
    return zlib.compress(json.dumps(counts).encode(), 1)


def _unpack(blob: bytes) -> Counter:
    return Counter(json.loads(zlib.decompress(blob)))


def _summaries(batches: Iterator[pd.DataFrame], path: str, limit: int) -> Iterator[pd.DataFrame]:
    split, counts = coder(path).pieces, Counter()
    for pdf in batches:
        for text in pdf.text:
            counts.update(split(text)[1:])
            if len(counts) > 8 * limit:
                counts = prune(counts, 2 * limit)
    for k in [k for k in counts if len(k) > 32]:
        del counts[k]
    yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "blob": [_pack(prune(counts, limit))]})


def frequent(docs: DataFrame, path: str, text: str = "text", limit: int = FREQUENT) -> dict[str, int]:
    """Piece -> tokens of the pieces that are frequent over all texts."""
    ship(docs.sparkSession)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Counter()
        for blob in pdf.blob:
            total.update(_unpack(blob))
        return pd.DataFrame({"slot": [int(pdf.slot.iloc[0]) // FAN_IN], "blob": [_pack(prune(total, limit))]})

    rows, n = docs.select(text_of(text).alias("text")), 0
    n = rows.rdd.getNumPartitions()
    rows = rows.mapInPandas(lambda it: tidied(_summaries(it, path, limit)), "slot int, blob binary")
    while n > 1:
        rows = rows.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInPandas(merged, "slot int, blob binary")
        n = -(-n // FAN_IN)
    total = Counter()
    for r in rows.collect():  # one row
        total.update(_unpack(r.blob))
    c = coder(path)
    return {k: _length(c, k) for k in total}


def _length(c, piece: str) -> int:
    """Of a piece that had a space before it."""
    return len(c.ids(piece if c.words else " " + piece))


def _drop() -> None:
    _kept.clear()
    coder.cache_clear()


def tables(path: str, pinned: dict[str, int], key: object) -> tuple[Kept, Kept]:
    if (path, key) not in _kept:
        take_over("token-counts", _drop)
        c = coder(path)
        _kept.clear()
        first = Kept(lambda p: len(c.ids(p)), limit=100_000)
        first.after = first
        inner = Kept(lambda p: _length(c, p), pinned, after=first)
        first.signs = inner.signs = {s: len(c.ids(s)) for s in ",.\n"}
        _kept[path, key] = inner, first
    return _kept[path, key]


def count(text: str, path: str, inner: Kept, first: Kept) -> int:
    c = coder(path)
    if c.added(text):
        return len(c.slow(text))
    pieces = c.pieces(text)
    return first[pieces[0]] + sum(map(inner.__getitem__, pieces[1:]))


def _counts(batches: Iterator[pd.DataFrame], path: str, table) -> Iterator[pd.DataFrame]:
    inner, first = tables(path, table.value, table.id if hasattr(table, "id") else id(table))
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.n_bytes, "n_tokens": [count(t, path, inner, first) for t in pdf.text]})


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", table: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(frequent(docs, path, text) if table is None else table)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(lambda it: tidied(_counts(it, path, shared)), "doc_id long, n_bytes long, n_tokens long")

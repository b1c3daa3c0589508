"""Packing documents into sequences of a fixed number of tokens: best fit, then swap-based local search.

Documents become token ids and a separator; longer ones than a sequence are cut into full pieces and a rest. Full pieces are
sequences of their own. The rests are dealt evenly over shards of a bounded number of pieces. In a shard, best-fit
decreasing fills bins; a local search then takes the emptiest bins and moves a document, exchanges one for one or two for
one with other underfull bins whenever that increases the sum of squared fills, until bins empty or nothing
helps. The emptiest bin of every shard meets those of other shards in a last round, so that shards cost no sequences.

Only (id, piece, length, checksum) rows are shuffled, never texts or ids.

Defined cases: a null or empty text is its separator alone; repeated rows are packed each; pieces that tie in length are taken by doc_id and piece; a very long
text is encoded whole in one task and cut; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept, coder
from .common import ship, staged, take_over, text_of, tidied

CAPACITY = 2048
#: Pieces that one task packs.
SHARD = 20_000
_kept: dict[str, Kept] = {}


def _drop() -> None:
    _kept.clear()
    coder.cache_clear()


def encoder(path: str) -> Kept:
    """piece of a text -> its ids as little-endian unsigned 32-bit numbers."""
    if path not in _kept:
        take_over("packing", _drop)
        c = coder(path)
        as_bytes = [i.to_bytes(4, "little") for i in range(c.library.get_vocab_size())].__getitem__
        _kept[path] = Kept(lambda p: b"".join(map(as_bytes, c.ids(p))), limit=80_000)
        _kept[path].signs = {s: _kept[path].make(s) for s in ",."}
    return _kept[path]


def encode(text: str, path: str, separator: int = 0) -> bytes:
    c, end = coder(path), separator.to_bytes(4, "little")
    if not c.words:
        return b"".join(i.to_bytes(4, "little") for i in c.slow(text)) + end
    return b"".join(map(encoder(path).__getitem__, c.pieces(text))) + end


def _pieces(batches: Iterator[pd.DataFrame], path: str, capacity: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        encoder(path)
        out = []
        for doc, text in zip(pdf.doc_id, pdf.text):
            ids = encode(text, path)
            for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                out.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
        yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places, by best-fit decreasing."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins


class Reach:
    """What may leave a bin, by key: an item's length and the room of its bin. Bins that change are put in anew."""

    def __init__(self, capacity: int) -> None:
        self.none = capacity + 1
        self.heaps: list[list[tuple[int, int, int, int]]] = [[] for _ in range(2 * capacity + 1)]  # length, bin, stamp, item
        self.least = np.full(2 * capacity + 1, self.none, np.int64)  # the shortest item of each key
        self.stamp: dict[int, int] = defaultdict(int)
        self.keys: dict[int, set[int]] = {}

    def put(self, b: int, room: int, items: list[tuple[int, int]]) -> None:
        """items: length, item."""
        self.keys[b] = {n + room for n, _ in items}
        for n, i in items:
            heappush(self.heaps[n + room], (n, b, self.stamp[b], i))
            self.least[n + room] = min(self.least[n + room], n)

    def take_out(self, b: int) -> None:
        self.stamp[b] += 1
        for key in self.keys.pop(b, ()):
            heap = self.heaps[key]
            while heap and heap[0][2] != self.stamp[heap[0][1]]:
                heappop(heap)
            self.least[key] = heap[0][0] if heap else self.none

    def find(self, sizes: list[int], width: int) -> tuple[int, int, int] | None:
        """The first size with a shorter item at a key of size to size + width - 1: its place, the item's bin, the item. Tightest first."""
        if not sizes or width < 1:
            return None
        hit = sliding_window_view(self.least, width)[sizes] < np.array(sizes)[:, None]
        some = hit.any(axis=1)
        if not some.any():
            return None
        k = int(some.argmax())
        _, b, _, item = self.heaps[sizes[k] + int(hit[k].argmax())][0]
        return k, b, item


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search from the emptiest bins, in passes over all underfull ones until one changes nothing; every step increases the sum of squared fills.

    A step that brings g tokens to a bin increases the sum if that bin is then fuller than the source was. For an item of
    length y that leaves for ones of s tokens, g = s - y, so y + the bin's room must be from s to less than s + the source's room.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    items, rooms = Reach(capacity), Reach(capacity)  # a bin's room: nothing leaves

    def put(b: int) -> None:
        if bins[b] and fill[b] < capacity:
            items.put(b, capacity - fill[b], [(lengths[i], i) for i in bins[b]])
            rooms.put(b, capacity - fill[b], [(0, -1)])

    def take_out(b: int) -> None:
        items.take_out(b)
        rooms.take_out(b)

    for b in range(len(bins)):
        put(b)
    changed = True
    while changed:
        changed = False
        for source in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            take_out(source)
            while bins[source]:
                width = capacity - fill[source]
                own: dict[int, list[int]] = defaultdict(list)
                for i in bins[source]:
                    own[lengths[i]].append(i)
                ones = sorted(own, reverse=True)
                groups = [[own[n][0]] for n in ones]
                step = rooms.find(ones, width) or items.find(ones, width)
                if not step:  # two for one
                    pairs = {n + m: [own[n][0], own[m][n == m]] for k, n in enumerate(ones) for m in ones[k:] if n != m or len(own[n]) > 1}
                    sizes = sorted(pairs, reverse=True)
                    groups = [pairs[n] for n in sizes]
                    step = items.find(sizes, width)
                if not step:
                    break
                k, b, back = step
                take_out(b)
                for i in groups[k]:
                    bins[source].remove(i)
                    bins[b].append(i)
                if back >= 0:
                    bins[b].remove(back)
                    bins[source].append(back)
                gain = sum(lengths[i] for i in groups[k]) - (lengths[back] if back >= 0 else 0)
                fill[b] += gain
                fill[source] -= gain
                put(b)
                changed = True
            put(source)
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def _pack_shard(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf.length.tolist()
    bins = pack(lengths, capacity)
    loose = min(range(len(bins)), key=lambda b: (sum(lengths[i] for i in bins[b]), b))
    number, offset, again = [0] * len(pdf), [0] * len(pdf), [False] * len(pdf)
    base = int(pdf.shard.iloc[0]) << 24
    for b, own in enumerate(bins):
        at = 0
        for i in own:
            number[i], offset[i], again[i] = base + 2 * b + last, at, b == loose and not last
            at += lengths[i]
    return pdf.assign(sequence_id=number, offset=offset, again=again)


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    cut = staged(rows.mapInPandas(lambda it: tidied(_pieces(it, path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    full = cut.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    packed = staged(rest.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity, False), f"{OUT}, shard long, again boolean"), "pack-bins")
    names = [c.split()[0] for c in OUT.split(", ")]
    loose = packed.filter("again").drop("sequence_id", "offset", "again").withColumn("shard", F.floor(F.col("shard") / 256))
    loose = loose.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity, True), f"{OUT}, shard long, again boolean")
    return full.select(*names).unionByName(packed.filter(~F.col("again")).select(*names)).unionByName(loose.select(*names))

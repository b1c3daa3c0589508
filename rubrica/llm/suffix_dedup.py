"""Repeated passages by a distributed merge sort of suffixes.

Texts are UTF-8 bytes. A suffix counts up to ``WINDOW`` bytes; a byte goes if a suffix that covers it also starts earlier
(smaller doc_id, or same document, earlier start). Fingerprints only rule suffixes out and say which ones to compare; every
removal is confirmed by bytes.

1. Of every window, the k-gram with the least hash is its anchor. Equal windows have equal anchors at equal places, so an anchor
   stands for the neighbouring windows that chose it. Sorted runs of anchors' fingerprints are exchanged. An anchor that occurs once
   settles its windows: they are kept. Of anchors whose surroundings (all that their windows cover) have equal fingerprints, all but the
   earliest one are strings for step 3, with the place of the earliest. Anchors with different surroundings are split.
2. The same with blocks of ``BLOCK`` windows around the anchors that were split; what differs still is split into single windows.
3. Neighbouring strings with the earliest ones at the same distance in the same document are chained to passages, cut at fixed places of that document. Each passage
   is sent once, and so is what it repeats; where both meet their bytes are compared, and what is equal goes.
4. The single windows are sorted. Each task sends them as sorted, front-coded runs, dealt by fingerprint; the
   receiving task merges the runs with a loser tree that keeps with every contender the length of the prefix it shares with the
   last winner, decides most matches by these lengths alone and compares bytes only beyond them. In the merged order, neighbours
   that share all bytes are one string, of which the earliest start stays; the windows of all others go.

Every task reduces its own runs first, comparing bytes, so a passage that is in a third of all documents comes once from every task; an anchor
with more than ``HOT`` surroundings in a task goes on to the next round unsent. Anchors with several surroundings come together
in a tree of ``FAN_IN`` runs each, with the same reduction, so that no task gets them from every run at once. Fingerprints have 64 bits; two that are
equal by chance can keep a byte that repeats, but not remove one. Of verdicts, only places are sent. Texts are sent once, to be written
in buckets of their ids; they are read again for each round, and meet their verdicts in a join that leaves them where they are.

Defined cases: a null text is empty; documents shorter than a window keep all; a very long text is one task's, up to 2**28 bytes, beyond which the query
raises; rows that share an id are ordered by start alone, so that equal rows fare alike (all keep what no other document has earlier);
null ids come last; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, ship, small, staged, text_of, tidied

WINDOW, ANCHOR, BLOCK = 100, 40, 4
#: Anchors in a run, strings in a run, entries that a receiving task gets on average, surroundings of an anchor that a task sends, runs that come together.
RUN, STRING_RUN, SHARE, HOT, FAN_IN = 400_000, 50_000, 400_000, 64, 64
#: Bytes of text under a run, windows of a passage that is sent as one, bytes of passages in a blob and those that a task gets on average.
RUN_BYTES, PIECE, SENT_BYTES, GOT_BYTES = 32_000_000, 4096, 4_000_000, 16_000_000
#: At most so many items (of 8 bytes) of so many documents are broadcast.
BROADCAST_ITEMS, BROADCAST_DOCS = 1_000_000, 200_000
LAST = 2**63 - 1
_U = np.uint64
_B = 0x9E3779B97F4A7C15
_PLACE = _U(2**28 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        m = max(1 << 16, 2 * n)
        for i, base in enumerate((_B, pow(_B, -1, 2**64))):
            _powers[i] = np.concatenate([np.ones(1, _U), np.cumprod(np.full(m, base, _U))])
    return _powers


class Text:
    """Fingerprints of all substrings of one text."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.n = raw, len(raw)
        if self.n >= 1 << 28:
            raise ValueError(f"a text of {self.n} bytes; at most {(1 << 28) - 1} are supported")
        up, self.down = _power(self.n)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_TABLE[np.frombuffer(raw, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        length = (hi - lo).astype(_U) * _U(0xA0761D6478BD642F)
        return _mix(_mix((self.sums[hi] - self.sums[lo]) * self.down[lo]) + length + np.asarray(salt).astype(_U) * _U(0xE7037ED1A0B428DB))

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """core fingerprint (mixed anew, for anchors have low hashes), place of each anchor, first window that chose it, number of such windows."""
        grams = self.grams(k)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
        width, have = window - k + 1, 1
        while have < width:  # sliding minimum by doubling
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        at = (least & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        place = at[first]
        return _mix(grams[place]), place, first, np.diff(np.append(first, len(at)))


# A run: columns core, ctx (fingerprints), ord, th (document), a (order within it), lo, n (first window and number of windows)
_FIELDS = (("core", _U), ("ctx", _U), ("ord", np.int64), ("th", np.int64), ("a", np.uint32), ("back", np.uint8), ("n", np.uint8))


def _pack(run: dict[str, np.ndarray]) -> bytes:
    """Sorted by core: cores front-coded as differences; bytes of equal weight together."""
    import zstandard

    planes = []
    for name, kind in _FIELDS:
        x = run[name].astype(kind)
        if name == "core":
            x = np.diff(x, prepend=_U(0))
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return zstandard.compress(b"".join(planes), 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw, out, at = zstandard.decompress(blob), {}, 0
    n = len(raw) // sum(np.dtype(kind).itemsize for _, kind in _FIELDS)
    for name, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(x.T).view(kind).reshape(n)
        at += n * size
    out["core"] = np.cumsum(out["core"], dtype=_U)
    return out


def _gone(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 31 | length.astype(np.int64)


_ALIKE = 1 << 60


def _alike(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The string of n windows from lo on is to be compared."""
    return -1 - (_ALIKE | lo.astype(np.int64) << 8 | n.astype(np.int64))


def _open(a: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -1 - (a.astype(np.int64) << 16 | back.astype(np.int64) << 8 | n.astype(np.int64))


def _settle(run: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of a run in order of core: place of the first one with the same core and surroundings; how many surroundings the core has."""
    core = run["core"]
    m = len(core)
    head, kinds = np.arange(m), np.ones(m, np.int64)
    if not m:
        return head, kinds
    edge = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
    many = np.diff(np.append(edge, m))
    at = np.flatnonzero(np.repeat(many, many) > 1)
    if len(at):
        at = at[np.lexsort((run["a"][at], run["ord"][at], run["ctx"][at], core[at]))]
        c, x = core[at], run["ctx"][at]
        new_core = np.concatenate([[True], c[1:] != c[:-1]])
        new = new_core | np.concatenate([[True], x[1:] != x[:-1]])
        head[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        group = np.cumsum(new_core) - 1
        kinds[at] = np.bincount(group, new)[group].astype(np.int64)
    return head, kinds


def _same_place(run: dict[str, np.ndarray], head: np.ndarray) -> np.ndarray:
    """The first ones themselves, and equal rows of their id: their places are one."""
    return (run["ord"] == run["ord"][head]) & (run["a"] == run["a"][head])


_COLUMNS = ["ord", "th", "item", "hord", "hth", "hlo"]


def _table(run: dict[str, np.ndarray], *parts: tuple[np.ndarray, ...]) -> pd.DataFrame:
    """parts: which entries, their items; of strings also the entries that they repeat (hord, hth: the document, hlo: the first window)."""
    first = {"hord": run["ord"], "hth": run["th"], "hlo": run["a"].astype(np.int64) - run["back"]}
    own = {c: np.concatenate([run[c][p[0]] for p in parts]) for c in ("ord", "th")} | {"item": np.concatenate([p[1] for p in parts])}
    return pd.DataFrame(own | {c: np.concatenate([x[p[2]] if len(p) > 2 else np.zeros(len(p[0]), np.int64) for p in parts]) for c, x in first.items()})


def _strings_of(run: dict[str, np.ndarray], which: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, ...]:
    return which, _alike(run["a"][which].astype(np.int64) - run["back"][which], run["n"][which]), head[which]


def _splits_of(run: dict[str, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return which, _open(run["a"][which], run["back"][which], run["n"][which])


def _merged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first) - start[first]


def _fewer(items: pd.DataFrame) -> pd.DataFrame:
    """Items whose intervals are merged per document."""
    gone = items[items["item"] >= 0].sort_values(["ord", "th"], kind="stable")
    if not len(gone):
        return items
    o, t, x = (gone[c].to_numpy() for c in ("ord", "th", "item"))
    edge = np.append(np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])), len(o))
    out = [items[items["item"] < 0]]
    for a, b in zip(edge[:-1], edge[1:]):
        s, n = _merged(x[a:b] >> 31, x[a:b] & (2**31 - 1))
        out.append(pd.DataFrame({"ord": o[a], "th": t[a], "item": _gone(s, n)}).reindex(columns=items.columns, fill_value=0))
    return pd.concat(out)


_RUN_OUT = "bucket int, kind int, slot int, blob binary"
#: What blobs hold: entries, items, entries of cores with several surroundings, passages.
_ENTRIES, _OWN, _BUSY, _PASSAGES = range(4)


def _blob_of(items: pd.DataFrame) -> bytes:
    import zstandard

    return zstandard.compress(items.reindex(columns=_COLUMNS, fill_value=0).to_numpy(np.int64).tobytes(), 1)


def _items_in(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    import zstandard

    return [pd.DataFrame(np.frombuffer(zstandard.decompress(b), np.int64).reshape(-1, len(_COLUMNS)), columns=_COLUMNS) for b in pdf.blob[pdf.kind == _OWN]]


def _joined(runs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    run = {k: np.concatenate([r[k] for r in runs]) for k, _ in _FIELDS}
    order = np.argsort(run["core"], kind="stable")
    return {k: x[order] for k, x in run.items()}


def _unsent(run: dict[str, np.ndarray], send: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of an anchor with very many surroundings the first HOT are sent, for others to meet; all go on."""
    at = np.flatnonzero((kinds > HOT) & send)
    if len(at):
        c = run["core"][at]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(at)), 0))
        send[at[np.arange(len(at)) - start >= HOT]] = False
    return at


def _dealt(run: dict[str, np.ndarray], send: np.ndarray, kinds: np.ndarray, buckets: int, slot: int) -> list[tuple]:
    out = []
    for kind, which in ((_ENTRIES, send & (kinds == 1)), (_BUSY, send & (kinds > 1))):
        own = {k: x[which] for k, x in run.items()}
        to = ((own["core"] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        out += [(b, kind, slot, _pack({k: x[i:j] for k, x in own.items()})) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
    return out


def _equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 20_000):
        own = slice(lo, lo + 20_000)
        step = np.arange(length[own].max())
        inside = step < length[own][:, None]
        x, y = (text[np.where(inside, p[own][:, None] + step, 0)] for p in (a, b))
        out[own] = (x == y).all(1)
    return out


def _send(parts: list[tuple], raws: list[bytes], buckets: int, window: int, slot: int) -> pd.DataFrame:
    """parts: tuples of arrays in the order of _FIELDS and starts of windows in the joined raws. Blobs for the buckets, and one with what is known already."""
    run = {name: np.concatenate([p[i] for p in parts]).astype(kind) for i, (name, kind) in enumerate(_FIELDS)}
    at = np.concatenate([p[len(_FIELDS)] for p in parts])
    order = np.argsort(run["core"], kind="stable")
    run, at = {k: x[order] for k, x in run.items()}, at[order]
    head, kinds = _settle(run)
    later = np.flatnonzero(head != np.arange(len(head)))
    equal = np.zeros(len(head), bool)
    if len(later):
        equal[later] = _equal_bytes(np.frombuffer(b"".join(raws), np.uint8), at[later], at[head[later]], run["n"][later].astype(np.int64) - 1 + window)
    send = ~equal | _same_place(run, head)
    gone = np.flatnonzero(~send)
    hot = _unsent(run, send, kinds)
    lo = run["a"].astype(np.int64) - run["back"]
    own = pd.concat([_fewer(_table(run, (gone, _gone(lo[gone], run["n"][gone].astype(np.int64) - 1 + window)))), _table(run, _splits_of(run, hot))])
    out = [(slot % buckets, _OWN, slot, _blob_of(own))] if len(own) else []
    return pd.DataFrame(out + _dealt(run, send, kinds, buckets, slot), columns=["bucket", "kind", "slot", "blob"])


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of cores with several surroundings as one."""
    run = _joined([_unpack(b) for b in pdf.blob])
    head, kinds = _settle(run)
    send = _same_place(run, head)
    own = _table(run, _strings_of(run, np.flatnonzero(~send), head), _splits_of(run, _unsent(run, send, kinds)))
    slot = int(pdf.slot.iloc[0]) // FAN_IN
    out = [(int(pdf.bucket.iloc[0]), _OWN, slot, _blob_of(own))] if len(own) else []
    if send.any():
        out.append((int(pdf.bucket.iloc[0]), _BUSY, slot, _pack({k: x[send] for k, x in run.items()})))
    return pd.DataFrame(out, columns=["bucket", "kind", "slot", "blob"])


def _receive(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _items_in(pdf)
    runs = [_unpack(b) for b in pdf.blob[pdf.kind != _OWN]]
    if runs:
        run = _joined(runs)
        head, kinds = _settle(run)
        first = _same_place(run, head)
        out.append(_table(run, _strings_of(run, np.flatnonzero(~first), head), _splits_of(run, np.flatnonzero(first & (kinds > 1)))))
    return pd.concat(out)


def _runs(batches: Iterator[pd.DataFrame], entries, buckets: int, window: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    parts, raws, size, total, slot = [], [], 0, 0, TaskContext.get().partitionId()
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            own = entries(row)
            if own is not None:
                raw, core, ctx, a, back, count = own
                n = len(core)
                parts.append((core, ctx, np.full(n, row.ord), np.full(n, row.th), a, back, count, a - back + total))
                raws.append(raw)
                size, total = size + n, total + len(raw)
                if size >= RUN or total >= RUN_BYTES:
                    yield _send(parts, raws, buckets, window, slot)
                    parts, raws, size, total = [], [], 0, 0
    if parts:
        yield _send(parts, raws, buckets, window, slot)


def _anchored(row, window: int, k: int):
    raw = row.text.encode("utf-8", "surrogatepass")
    if len(raw) < window:
        return None
    text = Text(raw)
    core, place, first, n = text.anchors(window, k)
    back = place - first
    return raw, core, text.of(first, first + n - 1 + window, back), place, back, n


def _blocked(row, window: int, block: int):
    text = Text(row.text.encode("utf-8", "surrogatepass"))
    x = np.unique(-1 - np.asarray(row.items, np.int64))
    a, back, n = x >> 16, x >> 8 & 255, x & 255
    low, high = (back - n + 1) // block, back // block  # blocks by the anchor's place in a window
    many = high - low + 1
    which = np.repeat(np.arange(len(a)), many)
    j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[which]
    a, back, n = a[which], back[which], n[which]
    first, last = np.maximum(a - back, a - block * j - block + 1), np.minimum(a - back + n - 1, a - block * j)
    inner = a - block * j
    core = text.of(inner, inner - block + 1 + window, j)
    return text.raw, core, text.of(first, last + window, (a - first) * 256 + (last - first)), last, last - first, last - first + 1


def _chained(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """batches: ord, th, strings (item, hord, hth, hlo of each, one after the other). Passages: where they begin, their bytes, and what they repeat."""
    for pdf in batches:
        doc = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf.strings])
        item, hord, hth, hlo = np.concatenate([*pdf.strings, np.zeros(0, np.int64)]).astype(np.int64).reshape(-1, 4).T
        x = (-1 - item) ^ _ALIKE
        lo, n = x >> 8, x & 255
        order = np.lexsort((hlo, hlo - lo, hth, hord, doc))
        doc, hord, hth, lo, n, hlo = (y[order] for y in (doc, hord, hth, lo, n, hlo))
        keys = (doc, hord, hth, hlo - lo)
        other = np.ones(len(doc), bool)
        other[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(other)
        end = np.maximum.accumulate(group << 32 | hlo + n) & (2**32 - 1)  # texts have less than 2**28 bytes
        new = other.copy()
        new[1:] |= hlo[1:] > end[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        begin, end = hlo[first], end[np.append(first[1:], len(end)) - 1]
        cuts = (end - 1) // PIECE - begin // PIECE + 1
        run = np.repeat(np.arange(len(first)), cuts)
        place = begin[run] // PIECE + np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        h, e = np.maximum(begin[run], place * PIECE), np.minimum(end[run], (place + 1) * PIECE)
        at = first[run]
        yield pd.DataFrame({"ord": pdf.ord.to_numpy()[doc[at]], "th": pdf.th.to_numpy()[doc[at]], "at": h - (hlo - lo)[at], "length": e - h - 1 + window, "hord": hord[at], "hth": hth[at], "hlo": h})


def _strings(row, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Fingerprints, starts and bytes (after a byte that is 1) of the windows that are still open; a part at a time."""
    text = Text(row.text.encode("utf-8", "surrogatepass"))
    x = -1 - np.asarray(row.items, np.int64)
    a, back, n = x >> 16, x >> 8 & 255, x & 255
    keys = np.unique(np.repeat(a - back - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.raw, np.uint8), window)
    for i in range(0, len(keys), STRING_RUN):
        lo = keys[i : i + STRING_RUN]
        rows = np.ones((len(lo), window + 1), np.uint8)
        rows[:, 1:] = view[lo]
        yield text.of(lo, lo + window), lo, np.ones(len(lo), np.int64), rows


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted strings of one length: the prefix each shares with the one before, and what follows it."""
    n, width = rows.shape
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return lcp, rows[np.arange(width) >= lcp[:, None]].tobytes()


class FrontCoded:
    """A sorted run, read one string at a time: (shared with the one before, string)."""

    def __init__(self, lcp: np.ndarray, rest: bytes, width: int) -> None:
        self.lcp, self.rest, self.width, self.at, self.i, self.now = lcp.tolist(), rest, width, 0, 0, b""

    def next(self) -> int | None:
        if self.i == len(self.lcp):
            return None
        shared = self.lcp[self.i]
        more = self.width - shared
        self.now = self.now[:shared] + self.rest[self.at : self.at + more]
        self.at += more
        self.i += 1
        return shared


def merge(runs: list[FrontCoded]) -> Iterator[tuple[int, int, int]]:
    """The strings of all runs in order: (run, place in the run, prefix shared with the string before).

    A loser tree: every inner node holds the contender that lost there, and the prefix that it shares with the one it lost to. On the
    winner's path all those prefixes refer to the winner, so of two contenders the one that shares more with it comes first;
    bytes are compared only when both share equally much, and only beyond that.
    """
    width = runs[0].width
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    runs = [*runs, *[FrontCoded(np.zeros(0, np.uint8), b"", width)] * (leaves - len(runs))]
    from_bytes = int.from_bytes
    loser, shared = [0] * leaves, [0] * leaves
    ended = -1  # as a shared prefix: comes after all others

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """winner, what it shares with the last winner, loser, what it shares with this winner."""
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        if la == ended:
            return a, la, b, lb
        x, y = runs[a].now, runs[b].now
        x, y = from_bytes(x[la:]), from_bytes(y[la:])
        if x == y:
            return (a, la, b, width) if a < b else (b, la, a, width)
        same = width - (((x ^ y).bit_length() + 7) >> 3)
        return (a, la, b, same) if x < y else (b, la, a, same)

    def build(node: int) -> tuple[int, int]:
        if node >= leaves:
            r = node - leaves
            return r, ended if runs[r].next() is None else 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        a, la, loser[node], shared[node] = play(a, la, b, lb)
        return a, la

    winner, lcp = build(1) if leaves > 1 else (0, ended if runs[0].next() is None else 0)
    while lcp != ended:
        yield winner, runs[winner].i - 1, lcp
        got = runs[winner].next()
        lcp = ended if got is None else got
        node = (winner + leaves) >> 1
        while node:
            other = shared[node]
            if lcp > other:
                pass
            elif lcp < other:
                loser[node], winner = winner, loser[node]
                shared[node], lcp = lcp, other
            else:
                winner, lcp, loser[node], shared[node] = play(winner, lcp, loser[node], other)
            node >>= 1


def _string_runs(batches: Iterator[pd.DataFrame], buckets: int, window: int, width: int) -> Iterator[pd.DataFrame]:
    import zstandard
    from pyspark import TaskContext

    slot = TaskContext.get().partitionId()

    def passages(asked: list[tuple[np.ndarray, list[bytes]]]) -> pd.DataFrame:
        x, raws = np.concatenate([a for a, _ in asked]), [r for _, own in asked for r in own]  # ord, th, at, length, hord, hth, hlo
        with np.errstate(over="ignore"):
            key = _mix(x[:, 6].astype(_U) + _mix(x[:, 4].astype(_U) + _U(_B) * x[:, 5].astype(_U)))
        to = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts, out = np.searchsorted(to[order], np.arange(buckets + 1)), []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                blob = b"".join([int(j - i).to_bytes(8, "little"), np.ascontiguousarray(x[order[i:j]].T).tobytes(), *(raws[r] for r in order[i:j])])
                out.append((b, _PASSAGES, slot, zstandard.compress(blob, 1)))
        return pd.DataFrame(out, columns=["bucket", "kind", "slot", "blob"])

    def send(parts: list[tuple]) -> pd.DataFrame:
        h, ord_, th, at, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        rows = np.concatenate([p[5] for p in parts])
        order = np.lexsort((at, ord_, rows.reshape(-1).view(f"S{width}")))
        h, ord_, th, at, n, rows = h[order], ord_[order], th[order], at[order], n[order], rows[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        gone = (ord_ != ord_[head]) | (at != at[head])
        own = _fewer(pd.DataFrame({"ord": ord_[gone], "th": th[gone], "item": _gone(at[gone], n[gone] - 1 + window)}))
        out = [(slot % buckets, _OWN, slot, _blob_of(own))] if len(own) else []
        keep = ~gone
        h, ord_, th, at, n, rows = h[keep], ord_[keep], th[keep], at[keep], n[keep], rows[keep]
        to = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                x = order[i:j]
                lcp, rest = front_code(rows[x])
                blob = b"".join([int(j - i).to_bytes(8, "little"), ord_[x].tobytes(), th[x].tobytes(), at[x].astype(np.int64).tobytes(), n[x].astype(np.uint8).tobytes(), lcp.tobytes(), rest])
                out.append((b, _ENTRIES, slot, zstandard.compress(blob, 1)))
        return pd.DataFrame(out, columns=["bucket", "kind", "slot", "blob"])

    parts, size, asked, total = [], 0, [], 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.asks is not None and len(row.asks):
                x, raw = np.asarray(row.asks, np.int64).reshape(-1, 5), row.text.encode("utf-8", "surrogatepass")
                asked.append((np.concatenate([np.full((len(x), 2), (row.ord, row.th)), x], axis=1), [raw[a : a + n] for a, n in x[:, :2].tolist()]))
                total += int(x[:, 1].sum())
                if total >= SENT_BYTES:
                    yield passages(asked)
                    asked, total = [], 0
            for h, at, n, rows in () if row.items is None or not len(row.items) else _strings(row, window):
                parts.append((h, np.full(len(at), row.ord), np.full(len(at), row.th), at, n, rows))
                size += len(at)
                if size >= STRING_RUN:
                    yield send(parts)
                    parts, size = [], 0
    if parts:
        yield send(parts)
    if asked:
        yield passages(asked)


def _compared(blobs: list[bytes]) -> pd.DataFrame:
    """Of passages and what they repeat: those whose bytes are equal, as items."""
    import zstandard

    first, rest, out = {}, [], []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        at = 8 + 56 * n
        for ord_, th, lo, length, hord, hth, hlo in np.frombuffer(raw, np.int64, 7 * n, 8).reshape(7, n).T.tolist():
            own = raw[at : at + length]
            at += length
            if (ord_, th, lo) == (hord, hth, hlo):
                first[hord, hth, hlo, length] = own
            else:
                rest.append((ord_, th, lo, length, hord, hth, hlo, own))
    for ord_, th, lo, length, hord, hth, hlo, own in rest:
        if first.get((hord, hth, hlo, length)) == own:
            out.append((ord_, th, lo << 31 | length))
    return pd.DataFrame(out, columns=["ord", "th", "item"], dtype=np.int64)


def _merge_strings(pdf: pd.DataFrame, window: int, width: int) -> pd.DataFrame:
    import zstandard

    out, runs, where = _items_in(pdf), [], []
    out.append(_compared(pdf.blob[pdf.kind == _PASSAGES].tolist()))
    for blob in pdf.blob[pdf.kind == _ENTRIES]:
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        where.append(np.concatenate([np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n), np.frombuffer(raw, np.uint8, n, 8 + 24 * n)[None].astype(np.int64)]))
        runs.append(FrontCoded(np.frombuffer(raw, np.uint8, n, 8 + 25 * n), raw[8 + 26 * n :], width))
    if runs:
        r, i, lcp = np.fromiter((x for t in merge(runs) for x in t), np.int64).reshape(-1, 3).T
        base = np.concatenate([[0], np.cumsum([w.shape[1] for w in where])[:-1]])
        ord_, th, at, n = np.concatenate(where, axis=1)[:, base[r] + i]
        new = lcp < width
        new[0] = True
        group = np.cumsum(new) - 1
        order = np.lexsort((at, ord_, group))
        first = order[np.searchsorted(group, np.arange(group[-1] + 1))][group]  # group is sorted, and order keeps it so
        gone = (ord_ != ord_[first]) | (at != at[first])
        out.append(_fewer(pd.DataFrame({"ord": ord_[gone], "th": th[gone], "item": _gone(at[gone], n[gone] - 1 + window)})))
    return pd.concat([x[["ord", "th", "item"]] for x in out])


_ITEMS = "ord long, th long, item long"
_VERDICTS = ", ".join(f"{c} long" for c in _COLUMNS)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, items in zip(pdf.text, pdf["items"]):
            raw, spans = text.encode("utf-8", "surrogatepass"), []
            if items is not None and len(items):
                x = np.asarray(items, np.int64)
                s, n = _merged(x >> 31, x & (2**31 - 1))
                spans = list(zip(s.tolist(), (s + n).tolist()))
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [[a, b] for a, b in spans]))
        rows = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        rows.insert(0, "doc_id", pdf.doc_id.astype("Int64").to_numpy())
        yield rows


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<array<int>> (byte offsets)."""
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ids = ids.withColumn("ord", F.coalesce("doc_id", F.lit(LAST)))
    total = ids.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    alike = not small(ids.groupBy("ord").count().filter("count > 1"), 0)
    rows = ids.withColumn("th", F.xxhash64("text").bitwiseAND(2**31 - 1) if alike else F.lit(0).cast("long"))
    tasks = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = bucketed(rows, "suffix-texts", tasks, "ord", "th")
    buckets = max(1, -(-int(2 * total / (window - k)) // SHARE))

    def meeting(own: DataFrame, how: str = "inner") -> DataFrame:
        """own: ord, th, arrays. rows with these."""
        own = staged(own, "suffix-items")
        n, items = own.agg(F.count(F.lit(1)), F.sum(sum(F.greatest(F.size(c), F.lit(0)) for c in own.columns[2:]))).first()
        low = n <= BROADCAST_DOCS and (items or 0) <= BROADCAST_ITEMS
        return rows.join(F.broadcast(own) if low else own, ["ord", "th"], how)

    def listed(verdicts: DataFrame) -> DataFrame:
        return verdicts.groupBy("ord", "th").agg(F.collect_list("item").alias("items"))

    is_open, is_alike = (F.col("item") < 0) & (F.col("item") >= -_ALIKE), F.col("item") < -_ALIKE

    def settled(sent: DataFrame, name: str) -> DataFrame:
        n = tasks
        if n > FAN_IN:  # what very many runs share comes together in a tree
            sent = staged(sent, f"{name}-runs")
            rest, busy = sent.filter(F.col("kind") != _BUSY), sent.filter(F.col("kind") == _BUSY)
            while n > FAN_IN:
                busy = staged(busy.groupBy("bucket", F.floor(F.col("slot") / FAN_IN)).applyInPandas(_reduce, _RUN_OUT), f"{name}-runs")
                rest, busy = rest.union(busy.filter(F.col("kind") != _BUSY)), busy.filter(F.col("kind") == _BUSY)
                n = -(-n // FAN_IN)
            sent = rest.union(busy)
        return staged(sent.groupBy("bucket").applyInPandas(_receive, _VERDICTS), name)

    def total_open(verdicts: DataFrame) -> int:
        return verdicts.filter(is_open).agg(F.sum((-1 - F.col("item")).bitwiseAND(255))).first()[0] or 0

    sent = rows.select("ord", "th", "text").mapInPandas(lambda it: tidied(_runs(it, lambda r: _anchored(r, window, k), buckets, window)), _RUN_OUT)
    all_ = first = settled(sent, "suffix-anchors")
    left, more = total_open(first), first.filter(is_alike)
    if left:
        many = max(1, -(-2 * left // block // SHARE))
        sent = meeting(listed(first.filter(is_open))).select("ord", "th", "text", "items").mapInPandas(lambda it: tidied(_runs(it, lambda r: _blocked(r, window, block), many, window)), _RUN_OUT)
        second = settled(sent, "suffix-blocks")
        all_ = all_.union(second)
        left, more = total_open(second), more.union(second.filter(is_alike))
        single = listed(second.filter(is_open))
    else:
        single = listed(first.limit(0))
    strings = more.groupBy("ord", "th").agg(F.flatten(F.collect_list(F.array("item", "hord", "hth", "hlo"))).alias("strings"))
    found = strings.mapInPandas(lambda it: tidied(_chained(it, window)), "ord long, th long, at long, length long, hord long, hth long, hlo long")
    found = staged(found, "suffix-passages")
    ask = ["at", "length", "hord", "hth", "hlo"]
    found = found.select("ord", "th", *ask).union(found.select("hord", "hth", F.col("hlo").alias("at"), "length", "hord", "hth", "hlo").distinct())
    size = found.agg(F.sum("length")).first()[0] or 0
    if left or size:
        few = max(1, -(-left // (SHARE // 4)), -(-size // GOT_BYTES))
        asks = found.groupBy("ord", "th").agg(F.flatten(F.collect_list(F.array(*ask))).alias("asks"))
        sent = meeting(single.join(asks, ["ord", "th"], "full")).select("ord", "th", "text", "items", "asks")
        sent = sent.mapInPandas(lambda it: tidied(_string_runs(it, few, window, window + 1)), _RUN_OUT)
        all_ = all_.select("ord", "th", "item").union(staged(sent.groupBy("bucket").applyInPandas(lambda pdf: _merge_strings(pdf, window, window + 1), _ITEMS), "suffix-strings"))
    all_ = all_.filter("item >= 0")

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [_merged(x >> 31, x & (2**31 - 1)) for x in map(np.asarray, pdf["items"])]
            yield pd.DataFrame({"ord": pdf.ord, "th": pdf.th, "items": [_gone(s, n) for s, n in both]})

    united = all_.groupBy("ord", "th").agg(F.collect_list("item").alias("items")).mapInPandas(lambda it: tidied(unite(it)), "ord long, th long, items array<long>")
    end = meeting(united, "left")
    return end.select("doc_id", "text", "items").mapInPandas(lambda it: tidied(_digest(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")

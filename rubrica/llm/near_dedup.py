"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its word shingles, each hashed to 64 bits by one function; its sketch is the ``K`` smallest.
Equal sets are one node from the start, so copies are never paired. Then:

1. Inverted lists of retained values generate overlaps. Two documents at the threshold share at least ``least_shared``
   of their retained values (below 1 in 10^8 otherwise; surely for sets smaller than a sketch), so they meet in
   a list even if every node enters only the lists of its k - least_shared + 1 rarest values.
2. Nodes that have fewer values of long lists than they share with any partner leave these, for they share a value of a short list
   too. Lists that are short, or have become so, pair their members, unless sizes or bit maps of the sketches (``MAP`` words, which bound
   what two sketches share from above) rule a pair out before anything is sent. In a list that is still long, all members
   meet the one whose values are most widely shared, the likely origin of the copies: as many pairs as members.
3. The sketch of the union estimates the overlap; pairs far below the threshold go.
4. Jaccard is computed exactly, on full sets, for what is left. Pairs that hang together come to one place, to which each of their sets is sent once.
5. Where members of a long list are not yet in the component of the list's centre, pairs across components go through sizes and bit maps as
   in step 2, if the centre has at most ``NARROW`` members. If it has more, the list is split anew, by its members' full sets: by
   the rarest values that they have beside what is usual in the list (a sample shows what is, which matters for cost alone), and, for those that are
   close to it, by the usual values that they lack. Pages of one template share what is usual and nothing else, and copies with edits
   at different places do not lack the same. A list that is long again gets a centre of its own, and so on. Of the other lists, pairs
   across components whose sizes and places leave room for the threshold go through steps 3 and 4. No partner is lost, no list is cut.
6. Links become components by large-star and small-star steps.

Full sets are made again, only for documents in a pair, instead of being stored for all.

Words are maximal runs without space, \\t \\n \\v \\f \\r; A-Z are lower-cased, other letters kept. A document with fewer words than
a shingle is that sequence, as its one shingle; without words, or with null text, it has none and is linked with nothing.

Defined cases: repeated rows fall together; rows that share an id but not their words are each judged by their own
words; a null id is linked with nothing and its row is kept; of rows that tie in id and words the one with the least hash of its text
stays; a very long text is one set of all its shingles, in the memory of one task; an empty table gives
an empty table; further columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, small, staged, take_over, text_of, tidied
from .components import components

#: Retained values; members up to which a list pairs its members; rows of a list of step 5 that meet at one place; sets that meet a leading set at one place.
K, SHORT, X_BLOCK, Y_BLOCK, CROWD = 48, 32, 1024, 1024, 1024
#: Times that long lists are split; those of the last split are met as they are. Sets of a list that show which values are usual there; classes of these.
LEVELS, SAMPLED, USUAL = 5, 64, 4
#: Members up to which a list of step 5 is met as it is: narrow rows, of which few pairs pass.
NARROW = 512
#: 64-bit words of a sketch's bit map; pairs that are looked at at once.
MAP, PAIRS = 4, 200_000
#: Words whose hashes a worker keeps.
WORDS = 50_000
#: Rows of two or three short values that may be broadcast.
BROADCAST_ROWS = 500_000
MISS = 1e-8
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = [np.uint64(x) for x in (30, 27, 31)]
_MAPS = [f"m{i}" for i in range(MAP)]


class _Words(dict):
    """word -> 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _B
    x = (x ^ (x >> _S[1])) * _C
    return x ^ (x >> _S[2])


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed numbers."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out.view(np.int64))


def least_shared(n: Column, share: float, k: int = K) -> Column:
    """Retained values that a set of n shares at least with any set at the threshold."""
    safe = max(c for c in range(1, k + 1) if sum(comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(c)) < MISS or c == 1)
    whole = F.ceil(n * share - 1e-9).cast("int")
    return F.when(n <= int(share * k), F.greatest(whole, F.lit(1))).otherwise(F.lit(safe))


def _sketches(batches: Iterator[pd.DataFrame], width: int, k: int) -> Iterator[pd.DataFrame]:
    import xxhash

    take_over("near-dedup", _words.clear)
    for pdf in batches:
        sets = [shingle_set(t, width) for t in pdf.text]
        both = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        halves = np.array([[x & (2**64 - 1), x >> 64] for x in both], np.uint64).reshape(-1, 2).view(np.int64)
        sketches = [s[:k] for s in sets]
        maps = bit_maps(sketches)
        yield pd.DataFrame({"doc_id": pdf.doc_id, "th": pdf.th, "n": [len(s) for s in sets], "d1": halves[:, 0], "d2": halves[:, 1], "sketch": sketches} | {c: maps[:, i] for i, c in enumerate(_MAPS)}).astype({"doc_id": "Int64"})


def bit_maps(sketches: list[np.ndarray]) -> np.ndarray:
    """MAP words for each sketch, in which each value turns one bit: where two maps differ in d bits, the sketches differ in d values at least."""
    wide = 64 * MAP
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    at = np.concatenate([*sketches, np.zeros(0, np.int64)]) & (wide - 1)
    odd = (np.bincount(row * wide + at, minlength=len(sketches) * wide) & 1).astype(np.uint8).reshape(-1, wide)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _possible(batches: Iterator, percent: int, k: int) -> Iterator:
    """batches: lists of members (num, n, least, maps; where there are components, component and out). a, b: pairs of a list, across components one of
    which is out, that sizes and bit maps do not rule out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        flat, many = batch.column(0).flatten(), pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
        x = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
        own = np.arange(len(flat))
        after = np.repeat(np.cumsum(many), many) - own - 1  # members of the list behind this one
        done = np.concatenate([[0], np.cumsum(after)])
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, "right")) - 1)
            left = np.repeat(own[i:j], after[i:j])
            right = left + 1 + np.arange(len(left)) - np.repeat(done[i:j] - done[i], after[i:j])
            i = j
            n, m = x["n"][left].astype(np.int64), x["n"][right].astype(np.int64)
            fits = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            if "component" in x:
                fits &= (x["component"][left] != x["component"][right]) & (x["out"][left] | x["out"][right])
            left, right, n, m = left[fits], right[fits], n[fits], m[fits]
            differ = sum(np.bitwise_count((x[c][left] ^ x[c][right]).view(np.uint64)).astype(np.int64) for c in _MAPS)  # of signed numbers it counts the absolute value's
            fits = np.minimum(n, k) + np.minimum(m, k) - differ >= 2 * np.minimum(x["least"][left], x["least"][right])
            a, b = x["num"][left[fits]], x["num"][right[fits]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _paired(groups: DataFrame, percent: int, k: int) -> DataFrame:
    """groups: an array of members as ``_possible`` takes them. a, b."""
    return groups.mapInArrow(lambda it: tidied(_possible(it, percent, k)), "a long, b long")


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """nodes: num, node, d1, to (array of strings). num, n, full, to: the full set of each, made again from one of its documents."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        take_over("near-dedup", _words.clear)
        for pdf in batches:
            sets = [shingle_set(t, width) for t in pdf.text]
            d1 = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) & (2**64 - 1) for s in sets], np.uint64).view(np.int64)
            own = d1 == pdf.d1.to_numpy()  # of an id's rows, the one with this set
            yield pd.DataFrame({"num": pdf.num[own], "n": [len(s) for s, o in zip(sets, own) if o], "full": [s for s, o in zip(sets, own) if o], "to": pdf["to"][own]})

    wanted = staged(nodes.select(F.col("node").alias("doc_id"), "d1", "num", "to"), "near-wanted")
    rows = docs.join(F.broadcast(wanted) if small(wanted.select(F.explode_outer("to")), BROADCAST_ROWS) else wanted, "doc_id")
    return rows.select("num", "d1", "text", "to").mapInPandas(lambda it: tidied(full(it)), "num long, n int, full array<long>, to array<string>")


def _grouped(docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """node, component: of all pairs of nodes whose sets meet the threshold; those within one component need not be found."""
    share = percent / 100
    nodes = classes.select("num", "n", "sketch", F.size("sketch").alias("k"), least_shared(F.col("n"), share, k).alias("least"), *_MAPS)
    posts = nodes.select("num", F.explode("sketch").alias("v"))
    often = staged(posts.groupBy("v").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "near-often")
    # never broadcast by hand: it grows with the corpus, and the join should cost alike at every size
    mine = posts.join(often, "v").groupBy("num").agg(F.array_sort(F.collect_list(F.struct("often", "v"))).alias("common"), F.sum(F.log("often")).alias("centre"))
    mine = mine.join(nodes.drop("sketch"), "num")
    room = F.col("k") - F.col("least") + 1 - (F.col("k") - F.size("common"))  # values that occur once come first
    lists = mine.withColumn("at", F.explode(F.slice("common", F.lit(1), F.greatest(room, F.lit(0)))))
    # who has fewer values of long lists than a partner shares with it shares one of a short list too, and is found there
    frequent = F.size(F.filter("common", lambda x: x["often"] > SHORT)) >= F.col("least")
    member = ["num", "n", "least", *_MAPS]
    lists = lists.select(*member, "centre", F.col("at.v").alias("v"), F.col("at.often").alias("often"), frequent.alias("frequent"))
    lists = staged(lists.filter(f"often <= {SHORT} OR frequent"), "near-lists")
    near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    long = lists.filter(F.col("often") > SHORT)
    left = staged(long.groupBy("v").agg(F.count(F.lit(1)).alias("left")).filter("left > 1"), "near-left")
    short = lists.filter(F.col("often") <= SHORT).select("v", *member)
    short = short.union(long.select("v", *member).join(_bounded(left.filter(F.col("left") <= SHORT).select("v")), "v", "left_semi"))
    short = short.groupBy("v").agg(F.collect_list(F.struct(*member)).alias("all")).filter(F.size("all") > 1).select("all")
    pairs, comp = _paired(short, percent, k).withColumn("turned", F.lit(False)), None
    long = long.join(_bounded(left.filter(F.col("left") > SHORT).select("v")), "v", "left_semi").select(F.lit(0).cast("long").alias("p"), "v", "num", "n", "centre")
    for level in range(LEVELS):
        heart = long.groupBy("p", "v").agg(F.max_by(F.struct("num", "n"), F.struct("centre", F.bitwise_not("num"))).alias("c"))
        heart = staged(heart, "near-hearts")
        stars = long.join(_bounded(heart), ["p", "v"]).select(F.col("c.num").alias("p"), F.col("c.n").alias("pn"), F.col("num").alias("y"), "n", "centre").distinct()
        stars = staged(stars, "near-stars")
        star = stars.filter((F.col("p") != F.col("y")) & near(F.col("n"), F.col("pn"))).select(F.least("p", "y").alias("a"), F.greatest("p", "y").alias("b"), (F.col("p") > F.col("y")).alias("turned"))
        # turned: b leads; of a centre's pairs, the centre does, so that only the others' sets travel
        pairs = staged(pairs.union(star).groupBy("a", "b").agg(F.bool_or("turned").alias("turned")), "near-pairs")
        comp = _joined(comp, _confirmed(_tried(pairs, nodes, share, k), docs, classes, width, percent))
        rest = _split(docs, classes, nodes, stars, comp, width, percent, k, level == LEVELS - 1)
        if rest is None:
            return comp
        pairs, long = rest
        if long is None:
            break
    return _joined(comp, _confirmed(_tried(pairs, nodes, share, k), docs, classes, width, percent))


def _joined(comp: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components, given those of all links found before and the links a, b found since."""
    links = staged(found, "near-links")
    return staged(components(links if comp is None else comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "near-part")


def _tried(pairs: DataFrame, nodes: DataFrame, share: float, k: int) -> DataFrame:
    """pairs: a, b, turned (b leads). lead, other, n_lead, n_other: those that the sketch of the union does not rule out."""
    ends = staged(pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct(), "near-ends")
    nodes = nodes.join(_bounded(ends), "num", "left_semi")
    side = lambda c: nodes.select(F.col("num").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("least").alias(f"l{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    # the sketch of the union: the k least of both sketches, and how many of them are in both
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    enough = F.least("la", "lb", F.ceil(F.size(union) * share - 1e-9))
    first = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x))
    pairs = pairs.filter(both >= enough).select(first("a", "b").alias("lead"), first("b", "a").alias("other"), first("na", "nb").alias("n_lead"), first("nb", "na").alias("n_other"))
    return staged(pairs, "near-tried")


def _sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """ids: num, to. num, n, full, to."""
    return sets_of(docs, classes.select("num", "node", "d1").join(_bounded(ids), "num"), width)


def _met(pairs: DataFrame, leads, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """pairs: lead, other, note (a text). What leads (a function of num, to) has of the leading set, and b, nb, fb (the other set), note.
    A set that leads very many pairs is sent to several places, and the others are dealt to them."""
    places = staged(pairs.groupBy(F.col("lead").alias("num")).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("places")), "near-places")
    place = lambda num, i: F.concat_ws(":", num, i)
    leading = leads(staged(places.select("num", F.transform(F.sequence(F.lit(0), F.col("places") - 1), lambda i: place(F.col("num"), i)).alias("to")), "near-leads"))
    crowded = staged(places.filter("places > 1").select(F.col("num").alias("lead"), "places"), "near-crowded")
    dealt = pairs.join(_bounded(crowded), "lead", "left").withColumn("at", place(F.col("lead"), F.pmod(F.xxhash64("other"), F.coalesce("places", F.lit(1)))))
    others = _sets(staged(dealt.groupBy(F.col("other").alias("num")).agg(F.collect_list(F.concat_ws("|", "at", "note")).alias("to")), "near-others"), docs, classes, width)
    others = others.select(F.explode("to").alias("to"), F.col("num").alias("b"), F.col("n").alias("nb"), F.col("full").alias("fb"))
    cut = F.split("to", r"\|")
    return others.withColumns({"at": cut[0], "note": cut[1]}).join(leading.withColumn("at", F.explode("to")).drop("to"), "at")


def _checked(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """batches: num, n, full, place, partners (ids), places one after the other. a, b: the pairs that meet the threshold."""
    take_over("near-dedup", _words.clear)
    at, full, asked = None, {}, []

    def links() -> Iterator[tuple[int, int]]:
        for num, partners in asked:
            x = full[num]
            for other in map(int, partners.split(",")):
                y = full[other]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    yield num, other

    for pdf in batches:
        found = []
        for num, own, place, partners in zip(pdf.num, pdf.full, pdf.place, pdf.partners):
            if place != at:
                found += links()
                at, full, asked = place, {}, []
            full[num] = np.array(own)  # a copy: a view would keep its whole batch
            if partners:
                asked.append((num, partners))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
    yield pd.DataFrame(list(links()), columns=["a", "b"], dtype=np.int64)


def _confirmed(tried: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the pairs whose full sets meet the threshold.

    A pair's place is the least node that one of its two is paired with: one for all pairs of a group of copies, or of a centre. Sets are sent once to
    each of their places; those of a place stay in memory together, so pairs of a place with too many sets, or too large ones, go to places of their leading sets.
    """
    ends = tried.select(F.col("lead").alias("x"), F.col("other").alias("y")).union(tried.select("other", "lead"))
    least = _bounded(staged(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("its")), "near-least"))
    to = lambda c, its: least.select(F.col("x").alias(c), F.col("its").alias(its))
    placed = staged(tried.join(to("lead", "p"), "lead").join(to("other", "q"), "other").select("lead", "other", "n_lead", "n_other", F.least("p", "q").cast("string").alias("place")), "near-placed")

    def sets_at(placed: DataFrame) -> DataFrame:
        own = placed.select("place", F.col("lead").alias("num"), F.col("n_lead").alias("n"), F.col("other").alias("partner")).union(placed.select("place", "other", "n_other", F.lit(None).cast("long")))
        return staged(own.groupBy("place", "num").agg(F.first("n").alias("n"), F.concat_ws(",", F.collect_list(F.col("partner").cast("string"))).alias("partners")), "near-each")

    room = lambda n: F.greatest(F.ceil(F.count(F.lit(1)) / CROWD), F.ceil(F.sum(n) / (CROWD * 512))).cast("int")
    each = sets_at(placed)
    crowded = staged(each.groupBy("place").agg(room("n").alias("places")).filter("places > 1").select("place", F.lit(True).alias("crowded")), "near-crowded")
    if not small(crowded, 0):
        apart = staged(placed.join(_bounded(crowded), "place", "left"), "near-placed")
        leads = _bounded(staged(apart.filter("crowded").groupBy("lead").agg(room("n_other").alias("places")), "near-leads"))
        own = F.concat_ws(":", "lead", F.pmod(F.xxhash64("other"), "places"))
        each = sets_at(apart.join(leads, "lead", "left").withColumn("place", F.when(F.col("crowded"), own).otherwise(F.col("place"))))
    ids = staged(each.groupBy("num").agg(F.collect_list(F.concat_ws("|", "place", "partners")).alias("to")), "near-others")
    sets, cut = _sets(ids, docs, classes, width).withColumn("to", F.explode("to")), F.split("to", r"\|")
    sets = sets.select("num", "full", cut[0].alias("place"), cut[1].alias("partners")).repartition("place").sortWithinPartitions("place")
    return sets.mapInPandas(lambda it: tidied(_checked(it, percent)), "a long, b long")


def _usual(rows: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """rows: lead, other. num (the lead), u0, u1, ...: the values that several of some SAMPLED of its others have, by how many do. It only sets an order."""
    some = rows.join(_bounded(staged(rows.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SAMPLED).alias("each")), "near-each")), "lead")
    some = some.filter(F.pmod(F.xxhash64("other", "lead"), "each") == 0)
    some = staged(some.groupBy(F.col("other").alias("num")).agg(F.collect_set(F.col("lead").cast("string")).alias("to")), "near-some")
    sets = _sets(some, docs, classes, width).select("num", "full", F.explode("to").alias("lead")).dropDuplicates(["num", "lead"])
    sets = staged(sets.select(F.col("lead").cast("long").alias("lead"), "full"), "near-sampled")
    many = sets.groupBy("lead").agg(F.count(F.lit(1)).alias("many"))
    counts = sets.select("lead", F.explode("full").alias("v")).groupBy("lead", "v").agg(F.count(F.lit(1)).alias("have")).filter("have > 1").join(_bounded(staged(many, "near-many")), "lead")
    counts = counts.withColumn("u", F.least(F.floor(F.col("have") * USUAL / F.col("many")), F.lit(USUAL - 1)))
    return staged(counts.groupBy(F.col("lead").alias("num")).agg(*(F.collect_list(F.when(F.col("u") == i, F.col("v"))).alias(f"u{i}") for i in range(USUAL))), "near-usual")


def _split(docs: DataFrame, classes: DataFrame, nodes: DataFrame, stars: DataFrame, comp: DataFrame, width: int, percent: int, k: int, last: bool) -> tuple[DataFrame, DataFrame | None] | None:
    """stars: p (centre), pn, y, n, centre. What members of long lists that are not in the centre's component may be linked with:
    pairs (a, b, turned), and long lists that are to get a centre of their own (p, v, num, n, centre), or None without any; None if there are no such members.

    Members of centres that have few meet by their bit maps. Of the others:

    What half of a list has, by a sample, is its reference R; a set x has u values beside R and lacks m values of R. Two sets at the threshold
    (of distance |x + y| - 2|x & y| at most c(|x| + |y|)) then either share a value beside R. All values are put in one order, rare
    ones first, those of R last; so they share one of the first |x| - least + 1 values of both, where both still have as many values as they have to share.
    Or they share only values of R, which both nearly are. With w = u + m - c|x|, they lack max(0, (w_x + w_y) / 2) values of R in common: where that is 0, both are
    linked with the set of the least w; else they share one of the first values that they lack.
    None of this depends on how good the sample is, but for the number of pairs.
    """
    if small(stars, 0):
        return None
    found = lambda c, to: comp.select(F.col("node").alias(c), F.col("component").alias(to))
    all_ = stars.join(found("y", "cy"), "y", "left").join(found("p", "cp"), "p", "left")
    all_ = staged(all_.select("p", "y", "centre", F.coalesce("cy", "y").alias("component"), (F.coalesce("cy", "y") != F.coalesce("cp", "p")).alias("out")), "near-members")
    open_ = all_.groupBy("p").agg(F.count(F.lit(1)).alias("all"), F.count_if("out").alias("outs")).filter("outs > 0")
    open_ = staged(open_.select("p", (F.col("all") <= NARROW).alias("narrow")), "near-open")
    if small(open_, 0):
        return None
    narrow = all_.join(_bounded(open_.filter("narrow").select("p")), "p", "left_semi").select("p", F.col("y").alias("num"), "component", "out")
    narrow = nodes.select("num", "n", "least", *_MAPS).join(_bounded(staged(narrow, "near-narrow")), "num")
    narrow = _paired(narrow.groupBy("p").agg(F.collect_list(F.struct("num", "n", "least", *_MAPS, "component", "out")).alias("all")).select("all"), percent, k)
    narrow = narrow.distinct().withColumn("turned", F.lit(False))
    wide = open_.filter("NOT narrow").select("p")
    if small(wide, 0):
        narrow = staged(narrow, "near-late")
        return None if small(narrow, 0) else (narrow, None)
    rows = all_.join(_bounded(wide), "p", "left_semi").select(F.col("p").alias("lead"), F.col("y").alias("other"), F.concat_ws(",", "component", F.col("out").cast("int"), "centre").alias("note"))
    usual = _usual(rows, docs, classes, width)
    met = _met(rows, lambda ids: ids.join(_bounded(usual), "num", "left"), docs, classes, width)
    first = F.col("nb") - F.ceil(F.col("nb") * percent / 100 - 1e-9).cast("int") + 1
    known = [F.coalesce(F.col(f"u{i}"), F.array().cast("array<bigint>")) for i in range(USUAL)]
    half = USUAL // 2
    beside = F.concat(F.array_except("fb", F.concat(*known)), *(F.array_intersect("fb", u) for u in known[:half]))
    lacks = F.array_except(F.concat(*known[:half:-1], known[half]), F.col("fb"))
    note = F.split("note", ",")
    rows = met.select(
        F.col("num").alias("p"), F.col("b").alias("y"), F.col("nb").alias("n"), note[0].cast("long").alias("component"), (note[1] == "1").alias("out"), note[2].cast("double").alias("centre"),
        F.slice(beside, F.lit(1), first).alias("beside"), F.when(F.size(beside) < first, lacks).alias("lacks"), ((100 + percent) * (F.size(beside) + F.size(lacks)) - (100 - percent) * F.col("nb")).cast("long").alias("w"),
    )
    rows = staged(rows, "near-differences")
    hub = rows.filter("lacks IS NOT NULL").groupBy("p").agg(F.min("w").alias("least"), F.min_by("y", F.struct("w", "y")).alias("hub"), F.min_by("component", F.struct("w", "y")).alias("its"))
    rows = staged(rows.join(_bounded(staged(hub, "near-hubs")), "p", "left"), "near-differences")
    close = rows.filter((F.col("w") + F.col("least") <= 0) & F.col("lacks").isNotNull() & (F.col("component") != F.col("its"))).select(F.least("y", "hub").alias("a"), F.greatest("y", "hub").alias("b"), (F.col("hub") > F.col("y")).alias("turned"))
    # lists by what sets have beside R
    whole = [F.col(c) for c in ("p", "y", "n", "component", "out", "centre", "w")]
    posts = staged(rows.select(*whole, F.posexplode("beside").alias("pos", "v")), "near-posts")
    lists = posts.groupBy("p", "v").agg(F.count(F.lit(1)).alias("all"), F.count_if("out").alias("outs"), F.min("component").alias("low"), F.max("component").alias("high")).filter("all > 1 AND outs > 0 AND low <> high")
    lists = staged(lists.select("p", "v", "all", "outs", ((F.col("all") > NARROW) & F.lit(not last)).alias("again")), "near-sublists")
    long = staged(posts.join(_bounded(lists.filter("again").select("p", "v")), ["p", "v"], "left_semi").select("p", "v", F.col("y").alias("num"), "n", "centre"), "near-long")
    room = F.least(F.col("ln") - F.col("lpos"), F.col("rn") - F.col("rpos"))
    pairs = _across(posts, lists.filter("NOT again"), (100 + percent) * room >= percent * (F.col("ln") + F.col("rn")), percent)
    # lists by what sets lack of R
    step = 2 * (100 + percent)
    far = F.col("w") + F.col("least") > 0
    share = F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(far, F.col("least")).otherwise(1 - F.col("least"))) / step).cast("int"))
    many = F.size("lacks") - share + 1
    posts = rows.filter((F.size("lacks") > 0) & (many > 0)).select(*whole[:4], (F.col("out") & far).alias("out"), *whole[5:], F.size("lacks").alias("m"), F.posexplode(F.slice("lacks", F.lit(1), many)).alias("pos", "v"))
    posts = staged(posts, "near-posts")
    lists = posts.groupBy("p", "v").agg(F.count(F.lit(1)).alias("all"), F.count_if("out").alias("outs"), F.min("component").alias("low"), F.max("component").alias("high")).filter("all > 1 AND outs > 0 AND low <> high")
    room = F.least(F.col("lm") - F.col("lpos"), F.col("rm") - F.col("rpos"))
    alike = (room * step >= F.col("lw") + F.col("rw")) & (F.col("lw") + F.col("rw") > 0)
    pairs = pairs.union(_across(posts, staged(lists.select("p", "v", "all", "outs"), "near-sublists"), alike, percent)).distinct().withColumn("turned", F.lit(False))
    pairs = staged(pairs.union(close).union(narrow), "near-late")
    return None if small(pairs, 0) and small(long, 0) else (pairs, long)


def _across(posts: DataFrame, lists: DataFrame, fits: Column, percent: int) -> DataFrame:
    """a, b: pairs of a list whose components differ, one of which is out, and that fit. Long lists meet in blocks."""
    posts = posts.join(_bounded(lists.select("p", "v", F.ceil(F.col("outs") / X_BLOCK).cast("int").alias("bx"), F.ceil(F.col("all") / Y_BLOCK).cast("int").alias("by"))), ["p", "v"])
    side = lambda c: [F.col(x).alias(f"{c}{x}") for x in posts.columns if x not in ("p", "v", "bx", "by")]
    h, till = F.xxhash64("y", "p"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = posts.filter("out").select("p", "v", *side("l"), F.pmod(h, "bx").cast("int").alias("x_"), till("by").alias("y_"))
    right = posts.select("p", "v", *side("r"), F.pmod(h, "by").cast("int").alias("y_"), till("bx").alias("x_"))
    near = F.least("ln", "rn") * 100 >= F.greatest("ln", "rn") * percent
    met = left.join(right, ["p", "v", "x_", "y_"]).filter((F.col("lcomponent") != F.col("rcomponent")) & near & fits)
    return met.select(F.least("ly", "ry").alias("a"), F.greatest("ly", "ry").alias("b")).distinct()


def _numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """num: the least id of a class, or a number of its own where rows of one id make several classes."""
    twice = staged(classes.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("twice")), "near-twice")
    if small(twice, 0):
        return classes.withColumn("num", F.col("node")), False
    other = -1 - F.xxhash64("d1", "d2").bitwiseAND(2**63 - 1)
    return staged(classes.join(_bounded(twice), "node", "left").withColumn("num", F.when(F.col("twice"), other).otherwise(F.col("node"))).drop("twice"), "near-classes"), True


def _annotated(docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, th (hash of the text), n, component, kept."""
    ship(docs.sparkSession)
    keyed = docs.withColumn("th", F.xxhash64("text"))
    rows = staged(keyed.mapInPandas(lambda it: tidied(_sketches(it, width, k)), "doc_id long, th long, n int, d1 long, d2 long, sketch array<long>, " + ", ".join(f"{c} long" for c in _MAPS)), "near-rows")
    some = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("sketch", *_MAPS)))
    classes, twice = _numbered(staged(some, "near-classes"))
    comp = _grouped(docs, classes, width, percent, k)
    label = classes.select("d1", "d2", "n", "rows", "node", "num").join(_bounded(comp.select(F.col("node").alias("num"), "component")), "num", "left")
    if twice:  # numbers are not ids then
        label = staged(label, "near-labels")
        least = label.filter("component IS NOT NULL").groupBy("component").agg(F.min("node").alias("its"))
        label = label.join(_bounded(staged(least, "near-least")), "component", "left").withColumn("component", F.col("its"))
    label = label.filter("rows > 1 OR component IS NOT NULL").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    label = _bounded(staged(label, "near-labels"))
    its = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.select("doc_id", "th", "n", "d1", "d2").join(label, ["d1", "d2", "n"], "left").withColumn("component", its)
    return out.select("doc_id", "th", "n", "component", F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = _annotated(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), width, percent, k)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """The rows of docs that stay, one of each component, with all of docs' columns."""
    own, th, best = fresh(docs, "__id", "__th", "__best")
    found = _annotated(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), width, percent, k)
    found = staged(found.filter("doc_id IS NOT NULL AND n > 0"), "near-found")
    gone = staged(found.filter("NOT kept").select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct(), "near-gone")
    its = [F.col(doc_id).cast("long"), F.xxhash64(text_of(text))]
    left = docs.join(_bounded(gone), (its[0] == F.col(own)) & (its[1] == F.col(th)), "left_anti")
    ties = staged(found.filter("kept").groupBy("doc_id").agg(F.min("th").alias(best), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias(own), best), "near-ties")
    if small(ties, 0):
        return left.select(*docs.columns)
    worded = text_of(text).rlike(r"[^\x20\x09-\x0D]")
    left = left.join(_bounded(ties), its[0] == F.col(own), "left")
    one = left.filter(worded & (its[1] == F.col(best))).dropDuplicates([own])
    return left.filter(F.col(own).isNull() | ~worded).union(one).select(*docs.columns)

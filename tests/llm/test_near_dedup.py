"""Near-duplicates against all pairs, and components against a union-find."""

import random
import re
from collections import Counter

import pytest

from rubrica.llm import near_dedup, queries
from rubrica.llm.components import components

from .data import SF, clashing, empty, got, messy, rows


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def closed(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        at[find(a)] = find(b)
    return [find(i) for i in range(n)]


def by_definition(texts, width):
    """texts: (id, text). Rows as annotate gives them."""
    sets = [shingles(x, width) for _, x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and texts[i][0] is not None and texts[j][0] is not None and min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root, least = closed(len(texts), links), {}
    for r, (i, _) in zip(root, texts):
        least[r] = i if least.get(r) is None else min(i, least[r]) if i is not None else None
    return Counter((i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(texts, sets, root))


def have(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got(df))


@pytest.mark.parametrize("width", [2, 5])
def test_on_messy_rows(spark, width):
    assert have(near_dedup.annotate(clashing(messy(spark)), width=width)) == by_definition([(i, x) for i, x, *_ in rows()], width)
    df = clashing(messy(spark))
    stays = got(near_dedup.deduplicate(df, width=width))
    want = by_definition([(i, x) for i, x, *_ in rows()], width)
    worded = {k[0] for k in want if k[3] and k[1] and k[0] is not None}
    assert sorted(r["doc_id"] for r in stays if r["doc_id"] is not None and shingles(r["text"], width)) == sorted(worded)
    assert sum(1 for r in stays if r["doc_id"] is None or not shingles(r["text"], width)) == sum(n for k, n in want.items() if k[0] is None or not k[1])
    assert set(stays[0]) == set(df.columns)


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert have(queries.op6_near_dedup(spark, SF)) == by_definition(texts, 2)


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("how", [{}, {"SHORT": 3, "SAMPLED": 4, "LEVELS": 2, "NARROW": 4}, {"SHORT": 2, "SAMPLED": 1, "LEVELS": 3, "NARROW": 2}])
def test_large_groups_and_bridges(spark, monkeypatch, how):
    """Groups far above the length of short lists, with members that only meet each other; small blocks."""
    for name, value in ({"X_BLOCK": 7, "Y_BLOCK": 20, "CROWD": 9} | how).items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, base = [], [word() for _ in range(150)]
    for i in range(120):
        own = edited(rng, base, rng.choice([0, 0.02, 0.05, 0.09, 0.1]))
        texts.append(own)
        if i % 6 == 0:
            texts.append(edited(rng, own, 0.05))
            texts.append(edited(rng, texts[-1], 0.06))
    for n in (3, 6, 11, 40, 60):  # small sets at the threshold
        for _ in range(20):
            own = [word() for _ in range(n)]
            texts += [own, own[: -max(1, n // 6)], own + [word()], edited(rng, own, 0.05)]
    passage = [word() for _ in range(60)]  # shared by many, enough for few
    texts += [[word() for _ in range(rng.choice([2, 20, 100]))] + passage for _ in range(90)]
    rng.shuffle(texts)
    texts = [(i * 3 + 1, " ".join(x)) for i, x in enumerate(texts)]
    texts += [(4, texts[0][1] + " other words for the same id"), (4, "short"), (7, "short"), (7, "short")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert have(near_dedup.annotate(df, width=2)) == by_definition(texts, 2)


def test_templated_pages_cost_linear_candidates(spark, monkeypatch):
    """Pages that share most of their words, of which no two are similar, and a few that are; nobody meets everybody."""
    rng, tried, n = random.Random(8), [], 1500
    real = near_dedup._tried

    def counted(pairs, *how):
        tried.append(pairs.count())
        return real(pairs, *how)

    monkeypatch.setattr(near_dedup, "_tried", counted)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    template = [word() for _ in range(140)]
    texts = [(i, " ".join(template[:70] + [word() for _ in range(60)] + template[70:])) for i in range(n)]
    texts += [(n + i, texts[7 * i][1] + " end") for i in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in got(near_dedup.annotate(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), width=2))}
    assert found == {i: i for i in range(n)} | {n + i: 7 * i for i in range(40)}
    assert len(tried) == 2 and sum(tried) < 4 * n


def test_edits_of_one_base_cost_few_candidates(spark, monkeypatch):
    """Copies of a base that is not there, with up to four edits each: three and more leave most pairs just below the threshold."""
    rng, tried, n = random.Random(5), [], 700
    real = near_dedup._tried

    def counted(pairs, *how):
        tried.append(pairs.count())
        return real(pairs, *how)

    monkeypatch.setattr(near_dedup, "_tried", counted)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 3, 3, 4])):
            own[at] = word()
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert have(near_dedup.annotate(df, width=5)) == by_definition(texts, 5)
    assert sum(tried) < 25 * n


def test_bit_maps_keep_every_pair_that_shares_enough():
    """Sketches that share many values, few, and none; of chunks of any size, no pair that shares enough goes, and few others stay."""
    import numpy as np
    import pyarrow as pa

    rng, k, least = np.random.default_rng(6), near_dedup.K, 22
    sketches = []
    for _ in range(60):
        base = rng.integers(-(2**63), 2**63 - 1, k)
        for changed in (0, 1, 10, 24, 28, 40):
            sketches.append(np.unique(np.concatenate([base[changed:], rng.integers(-(2**63), 2**63 - 1, changed)])))
    maps = near_dedup.bit_maps(sketches)
    members = [{"num": i, "n": 400, "least": least} | {c: int(maps[i, j]) for j, c in enumerate(near_dedup._MAPS)} for i in range(len(sketches))]
    kind = pa.list_(pa.struct([("num", pa.int64()), ("n", pa.int32()), ("least", pa.int32()), *((c, pa.int64()) for c in near_dedup._MAPS)]))
    batch = pa.RecordBatch.from_arrays([pa.array([members[:1], members, members[5:7]], kind)], ["all"])
    found = [{pair for out in near_dedup._possible([batch], 80, k) for pair in zip(*(c.to_pylist() for c in out.columns))}]
    near_dedup.PAIRS, whole = 50, near_dedup.PAIRS
    found.append({pair for out in near_dedup._possible([batch], 80, k) for pair in zip(*(c.to_pylist() for c in out.columns))})
    near_dedup.PAIRS = whole
    want = {(i, j) for j in range(len(sketches)) for i in range(j) if len(np.intersect1d(sketches[i], sketches[j])) >= least}
    assert found[0] == found[1] and want <= found[0] and len(found[0]) < len(want) + 0.01 * len(sketches) ** 2


def test_groups_on_one_boilerplate_send_no_set_per_list(spark, monkeypatch):
    """Small groups that share boilerplate: no list of their values by position, and each set goes to a place once, not once for each of its pairs."""
    rng, sent = random.Random(11), []
    real = near_dedup._sets

    def counted(ids, *how):
        sent.append(sum(len(r["to"]) for r in ids.collect()))
        return real(ids, *how)

    monkeypatch.setattr(near_dedup, "_sets", counted)
    monkeypatch.setattr(near_dedup, "_usual", lambda *how: pytest.fail("lists of this size are not split by full sets"))
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    common, texts = [word() for _ in range(90)], []
    for g in range(12):
        own = common + [word() for _ in range(60)]
        for _ in range(20):
            copy = list(own)
            copy[rng.randrange(90, 150)] = word()
            texts.append((len(texts), " ".join(copy)))
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert have(near_dedup.annotate(df, width=2)) == by_definition(texts, 2)
    assert sum(sent) < 4 * len(texts)


def test_empty(spark):
    assert got(near_dedup.annotate(empty(spark))) == [] == got(near_dedup.deduplicate(empty(spark)))


def test_components(spark):
    rng = random.Random(2)
    n = 400
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, n), rng.randrange(200, n)) for _ in range(110)] + [(5, 5)]
    root = closed(n, links)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    want = {i: least[root[i]] for a, b in links if a != b for i in (a, b)}
    found = got(components(spark.createDataFrame(links, "a long, b long").repartition(3)))
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want


def test_components_not_converged(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="converged in 2 rounds"):
        components(links, rounds=2)

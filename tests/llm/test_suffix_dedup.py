"""Repeated passages against a dictionary of all windows; the loser tree against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rubrica.llm import queries, suffix_dedup

from .data import SF, clashing, empty, got, messy, rows


def by_definition(texts, window=100):
    """texts: (id, text). Counter of result rows."""
    order = lambda i: (i is None, i or 0)
    first = {}
    raws = [(i, (x or "").encode()) for i, x in texts]
    for i, raw in raws:
        for s in range(len(raw) - window + 1):
            w, place = raw[s : s + window], (order(i), s)
            if w not in first or place < first[w]:
                first[w] = place
    out = Counter()
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - window + 1):
            if (order(i), s) != first[raw[s : s + window]]:
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out[i, len(raw), int(gone.sum()), int((gone & ~np.roll(gone, 1)).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def have(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got(df))


def test_on_messy_rows(spark):
    assert have(suffix_dedup.removed(clashing(messy(spark)))) == by_definition([(i, x) for i, x, *_ in rows()])
    assert got(suffix_dedup.removed(empty(spark))) == []


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert have(queries.op2_suffix_dedup(spark, SF)) == by_definition(texts)


@pytest.mark.parametrize("small", [False, True])
def test_planted_repeats(spark, monkeypatch, small):
    if small:  # many runs, buckets and hot anchors
        for name, n in (("RUN", 50), ("STRING_RUN", 40), ("SHARE", 400), ("HOT", 2), ("FAN_IN", 2), ("BROADCAST_DOCS", 0)):
            monkeypatch.setattr(suffix_dedup, name, n)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (15, 18, 20, 25, 60, 200)] + ["a" * 250, "ab" * 130, "\x00" * 120]
    texts = []
    for i in range(150):
        parts = [words(rng.randrange(1, 40)), rng.choice(passages), words(rng.randrange(0, 9)), rng.choice(passages)]
        if rng.random() < 0.3:
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            parts.append(p[:at] + "#" + p[at + 1 :])
        texts.append(" ".join(parts[: rng.randrange(1, 6)]))
    texts += [texts[3], texts[4] + "!", "x" + texts[5], "b" * 99, "b" * 100, "b" * 101]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    pairs = list(zip(ids, texts)) + [(5, "another text with a known id " + passages[4])]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    assert have(suffix_dedup.removed(df)) == by_definition(pairs)


def test_removals_rest_on_bytes(spark, monkeypatch):
    """Fingerprints of which many are equal by chance: bytes that do not repeat stay."""
    real = suffix_dedup.Text.of
    monkeypatch.setattr(suffix_dedup.Text, "of", lambda self, lo, hi, salt=0: real(self, lo, hi, salt) & np.uint64(0xF << 32))
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(400))) for i in range(40)]
    texts += [(100, texts[3][1]), (101, texts[4][1][50:300])]
    raws = {i: x.encode() for i, x in texts}
    batch = __import__("pandas").DataFrame({"ord": [i for i, _ in texts], "th": 0, "text": [x for _, x in texts]})
    parts, raw, total = [], [], 0
    for row in batch.itertuples(index=False):
        r, core, ctx, a, back, n = suffix_dedup._anchored(row, 100, 40)
        parts.append((core, ctx, np.full(len(core), row.ord), np.full(len(core), 0), a, back, n, a - back + total))
        raw.append(r)
        total += len(r)
    sent = suffix_dedup._send(parts, raw, 1, 100, 0)
    gone = [x for df in suffix_dedup._items_in(sent) for x in df.itertuples(index=False) if x.item >= 0]
    assert gone and all(raws[x.ord][x.item >> 31 :][: x.item & (2**31 - 1)] in raws[3] + b"|" + raws[4] for x in gone) and {x.ord for x in gone} <= {100, 101}


def test_neighbouring_strings_are_one_passage(monkeypatch):
    """Strings at one distance from what they repeat are chained, gaps and other distances keep them apart, and cuts are at places of the first document."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    strings = [(10, 30, 1, 110), (40, 30, 1, 140), (65, 20, 1, 165), (90, 5, 1, 190), (95, 9, 1, 500), (104, 4, 2, 204)]  # lo, windows, first document, its lo
    flat = np.array([(suffix_dedup._alike(np.int64(lo), np.int64(n)), h, 0, hlo) for lo, n, h, hlo in strings[::-1]]).ravel()
    pdf = __import__("pandas").DataFrame({"ord": [5, 6], "th": [0, 0], "strings": [flat, flat[:0]]})
    found = {tuple(r) for out in suffix_dedup._chained(iter([pdf]), 100) for r in out.itertuples(index=False)}
    windows = [(10, 18, 1, 110), (28, 57, 1, 128), (90, 2, 1, 190), (92, 3, 1, 192), (95, 9, 1, 500), (104, 4, 2, 204)]
    assert found == {(5, 0, lo, n + 99, h, 0, hlo) for lo, n, h, hlo in windows}


def test_passages_and_texts_are_sent_once(spark, monkeypatch):
    """Of long passages whole pieces are asked for, not a string for every anchor; verdicts meet texts without a shuffle of texts."""
    real, rows_of = suffix_dedup.staged, {}
    monkeypatch.setattr(suffix_dedup, "BROADCAST_DOCS", 0)

    def counted(df, name):
        out = real(df, name)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counted)
    rng = random.Random(12)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [words(6000) for _ in range(4)]
    texts = [(i, words(rng.randrange(200)) + passages[i % 4][rng.randrange(300) :] + words(rng.randrange(200))) for i in range(24)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        end = suffix_dedup.removed(spark.createDataFrame(texts, "doc_id long, text string").repartition(6))
        plan = end._jdf.queryExecution().executedPlan().toString()
        assert have(end) == by_definition(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 20 <= rows_of["suffix-passages"] < 24 * 12
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1, plan  # of the items


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(0)
    for n_runs in (1, 2, 3, 7, 16):
        runs, want = [], []
        for r in range(n_runs):
            n = int(rng.integers(0, 60))
            strings = sorted({rng.choice(np.array([65, 66], np.uint8), 8).tobytes() + b"xx" for _ in range(n)})
            rows_ = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), 10)
            lcp, rest = suffix_dedup.front_code(rows_)
            assert len(rest) == 10 * len(strings) - lcp.sum()
            runs.append(suffix_dedup.FrontCoded(lcp, rest, 10))
            want += [(s, r, i) for i, s in enumerate(strings)]
        out = list(suffix_dedup.merge(runs))
        want.sort()
        assert [(r, i) for r, i, _ in out] == [(r, i) for _, r, i in want]
        shared = lambda a, b: next((k for k in range(10) if a[k] != b[k]), 10)
        assert [x for *_, x in out][1:] == [shared(a[0], b[0]) for a, b in zip(want, want[1:])]

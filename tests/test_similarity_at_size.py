"""All pairs of whole tables: what is sent grows with the rows, not with their square; the results are the plain ones."""

import re

import numpy as np
import pytest

from rubrica.operators import similarity

from .test_plans import plan


def _vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1).astype(np.float32)
    x[n // 2 :: 7] = x[0]  # one common vector
    return x, [(i, [float(a) for a in v]) for i, v in enumerate(x)]


def _sent(df) -> set[int]:
    """Into how many parts the rows of the plan are dealt."""
    return {int(n) for n in re.findall(r"Arguments: \w*\(?.*?pair_.*?, (\d+)\)?, REPARTITION_BY_NUM", plan(df))}


@pytest.mark.parametrize("numbers", [1 << 23, 4 * 90])
def test_top_k_is_dealt_to_a_grid(spark, monkeypatch, numbers):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "NUMBERS", numbers)
    monkeypatch.setattr(similarity, "ROWS", 16)
    monkeypatch.setattr(similarity, "COLUMNS", 32)
    x, rows = _vectors(spark, 700)
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    found = similarity.top_k_by_vector(df.selectExpr("id AS query", "vector"), df.selectExpr("id AS ord", "vector"), 5)
    assert _sent(found) == {64 if numbers == 4 * 90 else 48}  # 234 parts a side before
    got = {(r["query"], r["rank"]): (r.ord, r.similarity) for r in found.collect()}
    s = (x.astype(np.float64) @ x.astype(np.float64).T).round(12)
    want = {(i, k + 1): (j, s[i, j]) for i in range(len(x)) for k, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], -j))[:5])}
    assert got == want


@pytest.mark.parametrize("numbers", [1 << 23, 4 * 90])
def test_pages_are_dealt_to_a_grid(spark, monkeypatch, numbers):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "NUMBERS", numbers)
    monkeypatch.setattr(similarity, "ROWS", 16)
    monkeypatch.setattr(similarity, "COLUMNS", 32)
    x, rows = _vectors(spark, 300, 1)
    q = spark.createDataFrame([(i // 2, v) for i, v in rows] + [(999, None)], "query long, vector array<float>")
    p = spark.createDataFrame([(i % 7, v) for i, v in rows] + [(50, None)], "page_number int, vector array<float>")
    found = similarity.page_similarity(q, p, group=())
    assert _sent(found) == {48}  # 100 parts a side before
    got = {(r["query"], r.page_number): r.similarity for r in found.collect()}
    s = x.astype(np.float64) @ x.astype(np.float64).T
    want = {(i, n): s[2 * i : 2 * i + 2, n::7].max() for i in range(150) for n in range(7)} | {(i, 50): 0.0 for i in [*range(150), 999]}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_no_pairs(spark):
    none = spark.createDataFrame([], "query long, vector array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "page_number int, vector array<float>")
    assert similarity.page_similarity(none, some, group=()).count() == 0
    assert similarity.top_k_by_vector(none, some.selectExpr("page_number AS ord", "vector")).count() == 0

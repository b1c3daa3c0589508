"""Exact dedup, chat formatting, top-k search and token counts against SQL or the plain definition."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.llm import chat_format, exact_dedup, queries, token_counts, topk_search

from .data import DOCUMENT, SF, clashing, duck, empty, got, messy, rows, same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same_rows(got(queries.queries()[name](spark, SF)), duck(queries.oracle_sql()[name]))


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_by_definition(spark):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[norm(t)].append((i, t or ""))
    want = []
    for text, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        want += [{"doc_id": i, "keep_id": keep, "group_size": len(own), "kept": i == keep, "text_sha256": hashlib.sha256(text.encode()).hexdigest()} for i, _ in own]
    same_rows(got(exact_dedup.annotate(messy(spark))), want)
    kept = got(exact_dedup.deduplicate(clashing(messy(spark))))
    assert len(kept) == len(groups) and {norm(r["text"]) for r in kept} == set(groups)
    assert set(kept[0]) == set(clashing(messy(spark)).columns)


def test_exact_dedup_empty(spark):
    assert got(exact_dedup.annotate(empty(spark))) == [] == got(exact_dedup.deduplicate(empty(spark)))


def test_chat_round_trip_and_media(spark):
    turns = [(1, 0, "user", "hi <|im_end|> &amp; &lt;| <|"), (1, 1, "assistant", "<|im_start|>user\nno"), (1, 1, "assistant", None), (2, None, None, ""), (3, 5, "assistant", "a\n<|im_end|>\n"), (3, 5, "as\n|sistant", "x"), (None, 1, "user", "null id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(1))
    out = chat_format.format_chat(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    out = got(out.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))))
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    assert {r["conv_id"] for r in out} == set(by)
    for r in out:  # ties by role, then text
        own = sorted(by[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(b, c) for _, b, c in own]
        assert r["loss"] == "".join(c for _, b, c in own if b == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(own) == r["n_turns"]
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("video", None, "v", None, None, None, None), ("text", "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = got(chat_format.format_chat(df))[0]
    assert [(a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 38), (3, "document", "d.pdf", 512), (4, "video", "v", 0)]
    assert r["formatted"].count("<|image|>") == 4 and "&lt;|image|>" in r["formatted"]
    assert "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]) == "see &lt;|image|>end"
    assert got(chat_format.format_chat(df.limit(0))) == []


def test_topk_by_definition(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(130)] + [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (100, [0.5] * 6), (200, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("q_ids", F.lit(1)).repartition(5)
    fine = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    v = topk_search.quantised(df)
    want = []
    for q in sorted({i for i, _ in fine if i % 50 == 0}):
        own = min(x for i, x in fine if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in fine if i != q)[:5]
        want += [{"query_id": q, "rank": k + 1, "vec_id": i, "score": -s} for k, (s, i) in enumerate(best)]
    same_rows(got(topk_search.top_k(v, v.filter("vec_id % 50 = 0"))), want)
    none = topk_search.quantised(df.limit(0))
    assert got(topk_search.top_k(none, none)) == []


@pytest.mark.parametrize("limit", [3, 65536])
def test_token_counts(spark, limit):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [{"doc_id": i, "n_bytes": len((x or "").encode()), "n_tokens": len(t.encode(x or "", add_special_tokens=False).ids)} for i, x, *_ in rows()]
    df = clashing(messy(spark))
    same_rows(got(token_counts.token_counts(df, path, table=token_counts.frequent(df, path, limit=limit))), want)
    assert got(token_counts.token_counts(empty(spark, DOCUMENT), path)) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got(queries.op3_token_counts(spark, SF))}
    for r in docs.collect():
        n = len(t.encode(r.text, add_special_tokens=False).ids)
        assert have[r.doc_id] == (len(r.text.encode()), n, n > 512)


def test_exact_dedup_refines(spark):
    """Unique lengths have no prefix taken, unique prefixes no full hash."""
    texts = ["a", "bb", "cc", "ddd " * 40, "ddd " * 39 + "eee ", "ddd" * 40, "xxxx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["size"] for r in got(exact_dedup.survivors(df))) == [120]
    assert sorted(r["doc_id"] for r in got(exact_dedup.deduplicate(df))) == [0, 1, 2, 3, 4, 6]
    plan = exact_dedup.deduplicate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE WHEN" in line for line in plan.splitlines() if "sha2" in line)


def test_topk_of_many_shards(spark, monkeypatch):
    for name, n in (("CANDIDATES", 9), ("QUERIES", 3), ("SHARD", 2)):
        monkeypatch.setattr(topk_search, name, n)
    same_rows(got(queries.op4_topk_search(spark, SF)), duck(queries.ORACLES["op4_topk_search"]))

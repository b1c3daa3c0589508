"""Every stage of the pipeline against its definition, on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from rubrica.llm import mixing, toxicity

from .data import SF, clashing, empty, got, messy
from .test_model_ops import check_pack, plan
from .test_near_dedup import by_definition
from .test_simple_ops import norm


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def check(spark, found, toxic):
    docs, clean, once, near, mixed, packed = (list(x) for x in found)
    assert Counter(map(key, clean)) == Counter(key(r) for r in docs if not toxic[r["doc_id"], r["text"]])
    groups = defaultdict(list)
    for r in clean:
        groups[norm(r["text"])].append(r)
    best = lambda own: min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((r["doc_id"], norm(r["text"])) for r in once) == Counter((best(own)["doc_id"], t) for t, own in groups.items())
    want = by_definition([(r["doc_id"], r["text"]) for r in once], 5)
    assert Counter(r["doc_id"] for r in near) == Counter({k[0]: n for k, n in want.items() if k[3] or k[0] is None or not k[1]})
    have = Counter(map(key, mixed))
    assert set(have) <= set(map(key, near)) and max(have.values(), default=0) <= 2
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in near:
        sizes[r["source"]] += (n := len((r["text"] or "").split()))
        taken[r["source"]] += n * have[key(r)]
    for s, t in plan(sizes).items():
        largest = max((len((r["text"] or "").split()) for r in near if r["source"] == s), default=0)
        assert abs(taken[s] - t) <= max(0.05 * t, largest)
    check_pack(packed, [(r["doc_id"], r["text"]) for r in mixed])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r["doc_id"]: r["predicted"] for r in got(toxicity.score(docs, labels))}
    found = [got(d) for d in stages(spark, docs, SF, tmp_path)]
    check(spark, found, {(r["doc_id"], r["text"]): score[r["doc_id"]] for r in found[0]})


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = clashing(messy(spark))
    found = stages(spark, docs, SF, tmp_path)
    assert all(d.columns == docs.columns for d in found[:-1])
    rows = [got(d) for d in found]
    check(spark, rows, defaultdict(int))


def test_stages_on_no_rows(spark, tmp_path):
    assert all(got(d) == [] for d in stages(spark, empty(spark), SF, tmp_path))


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = got(corpus_pipeline.run(spark, SF))
    assert out and {r["doc_id"] for r in out} <= {r.doc_id for r in docs.collect()}
    assert mixing.BLOCK > 1

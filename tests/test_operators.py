"""Operators on literal rows: edges, ties, malformed input; attribution and thresholds against plain definitions."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica import rubrics
from rubrica.operators import attribution, generation, quality, rubric, scores, similarity, validate
from rubrica.operators.remediation import remediate
from rubrica.providers import FixedReplies, HashedTerms


def test_rubrics():
    assert [len(rubrics.sections(d)) for d in ("cancer", "cvd")] == [12, 11]
    assert [len(rubrics.names(d)) for d in ("cancer", "cvd", "anything")] == [76, 69, 69]
    for d, want in (("cancer", {5: 23, 3: 37, 2: 16}), ("cvd", {5: 21, 3: 32, 2: 16})):
        most = rubrics.max_scores(d)
        assert {k: list(most.values()).count(k) for k in want} == want
    assert len(rubrics.COMMONWEALTH) == 28


def test_normalised(spark):
    df = spark.createDataFrame([(3.0, 5), (2.0, 2), (5.0, 2), (1.0, None), (4.0, 0)], "s double, m int")
    assert [r[0] for r in df.select(rubrics.normalised(F.col("s"), F.col("m"))).collect()] == [3.0, 5.0, 12.5, 1.0, 0.0]


FACT = "country string, year string, category string, score double, position int"


def test_scores_of_plans(spark):
    rows = [("A", "1", "Health", 5.0, 0), ("A", "1", "Health", 1.0, 1), ("A", "1", "Vision", 3.0, 2), ("A", "1", "Unheard", 5.0, 3), ("B", "2", "Unheard", 5.0, 0)]
    facts = spark.createDataFrame(rows, FACT)
    got = {(r.country, r.section): r.score for r in scores.section_scores(facts).collect()}
    assert len(got) == 24 and got["A", "Outcomes"] == 1.0 and got["A", "Strategy"] == 5.0 and got["A", "Threats"] == got["B", "Outcomes"] == 0.0
    assert {r.country: (r.overall, r.n_scores) for r in scores.overall_scores(facts).collect()} == {"A": (statistics.median([5, 1, 5]), 3), "B": (0.0, 0)}
    assert scores.summary(facts).first().asDict() == {"total_plans": 2, "median_overall": 2.5, "mean_overall": 2.5}
    assert {r.section: (r.median, r.rank) for r in scores.section_medians(facts).collect()} == {"Outcomes": (3.0, 2), "Strategy": (5.0, 1)}
    assert [(r.list, r["rank"], r.section) for r in scores.top_and_bottom(facts).orderBy("list", "rank").collect()] == [("highest", 1, "Strategy"), ("highest", 2, "Outcomes"), ("lowest", 2, "Strategy"), ("lowest", 3, "Outcomes")]
    wide = {r.label: r for r in scores.comparison(facts).collect()}
    assert wide["A (1)"]["Strategy"] == 5.0 and wide["B (2)"]["Strategy"] == 0.0
    assert scores.section_scores(facts.limit(0)).count() == 0 and scores.summary(facts.limit(0)).first().total_plans == 0


def test_rubric_texts(spark):
    e = spark.createDataFrame([(0, "A", "def", ["i1", "i2"], ["s1"]), (1, "B", None, None, None), (2, "A", "later", [], [])], rubric.ENTRY)
    assert [(r.category, r.definition, r.ordinal) for r in rubric.latest(e).orderBy("ordinal").collect()] == [("B", None, 1), ("A", "later", 2)]
    kb = [(r.ord, r.content, r.type) for r in rubric.knowledge_base(e.limit(2)).orderBy("ord").collect()]
    assert kb == [(0, "Category: A\n\nDefinition: def\n\nRecommended Indicators:\n- i1\n- i2", "definition"), (1, "Scoring Rubric for A:\n\ns1", "scoring_rubric"), (2, "Category: B\n\nDefinition: ", "definition")]
    assert [r.context for r in rubric.prompt_context(e).collect()][:2] == ["## Sub-Element: A\n\n### Definition\ndef\n\n### Recommended Indicators\n- i1\n- i2\n\n### Scoring Criteria\n- s1", "## Sub-Element: B\n\n### Definition\n"]


def test_repair(spark):
    good = {"category": "x", "response": "r", "score": 3, "scoring_reasoning": "s", "response_page_citations": [1], "scoring_reasoning_page_citations": []}
    cases = [
        (good, 3, 6, [1]), (good | {"score": "4"}, 4, 5, [1]), (good | {"score": " 2 "}, 2, 5, [1]), (good | {"score": "high"}, 0, 5, [1]), (good | {"score": None}, 0, 5, [1]), (good | {"score": 9}, 5, 6, [1]), (good | {"score": -2}, 0, 6, [1]), (good | {"score": 2.9}, 2, 6, [1]), (good | {"score": True}, 1, 6, [1]),
        (good | {"response": 5}, 3, 5, [1]), (good | {"response": None}, 3, 5, [1]), (good | {"response_page_citations": "1"}, 3, 5, []), (good | {"response_page_citations": [1, "2", "x", None, 3.7, True, [1]]}, 3, 6, [1, 2, 3, 1]), ({}, 0, 0, []), ({k: v for k, v in good.items() if k != "score"}, 0, 5, [1]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0]), "right") for i, c in enumerate(cases)] + [(99, None, "right")], "i int, j string, category string")
    got = {r.i: r for r in quality.repair(df.withColumn("entry", F.parse_json("j"))).drop("entry").collect()}
    for i, (raw, score, right, cited) in enumerate(cases):
        r = got[i]
        assert (r.repaired.score, round(r.compliance * 6), r.repaired.response_page_citations) == (score, right, cited), raw
        assert len(r.schema_issues) == 6 - right and r.repaired.category == "right"
        assert r.repaired.response == (raw.get("response") if isinstance(raw.get("response"), str) else "")
    assert got[99].compliance == 0 and len(got[99].schema_issues) == 6
    assert got[13].schema_issues[0] == "Missing field: category"


@pytest.mark.parametrize(("rw", "sw", "indicators", "definition", "want", "n"), [(30, 20, [], "", 1.0, 0), (29, 20, [], "", 0.7, 1), (30, 19, [], "", 0.8, 1), (0, 0, ["zz yy"], "lengthy terms unmet", 0.1, 4), (30, 20, ["", "zz"], "abc", 0.8, 1), (30, 20, ["word zz", "zz yy xx", "q", "q2"], "word word", 0.6, 2)])
def test_coverage_edges(spark, rw, sw, indicators, definition, want, n):
    df = spark.createDataFrame([("word " * rw, "why " * sw, definition, indicators)], "r string, s string, d string, i array<string>")
    score, issues = quality.coverage(*map(F.col, "rsdi"))
    r = df.select(score.alias("x"), issues.alias("y")).first()
    assert (r.x, len(r.y)) == (pytest.approx(want), n)


def test_report_of_nothing_and_one(spark):
    rows = spark.createDataFrame([(1, "A", "word. " * 40, "why " * 20), (1, "Z", "", None)], "doc_id int, category string, response string, scoring_reasoning string")
    entries = spark.createDataFrame([("A", None, None)], "category string, definition string, indicators array<string>")
    got = quality.assess(rows, entries)
    r = quality.report(got).first()
    assert r.failed_categories == [x.category for x in got.orderBy("category").collect() if not x.passed] and r.total_issues == 2
    assert quality.report(got.limit(0)).count() == 0 and quality.failed(got).count() == len(r.failed_categories)


def test_acceptable(spark):
    rows = [("r" * 50, 5, "s" * 30, True), ("r" * 49, 5, "s" * 30, False), ("r" * 50, 6, "s" * 30, False), ("r" * 50, 0, "s" * 29, False), ("r" * 50 + "<Your response here>", 1, "s" * 30, False), ("r" * 50, 1, "s" * 30 + "[Explain the reasoning", False), (None, 1, "s" * 30, False)]
    df = spark.createDataFrame(rows, "r string, k int, s string, want boolean")
    assert all(x[0] == x[1] for x in df.select(quality.acceptable(F.col("r"), F.col("k"), F.col("s")), "want").collect())


def two_means(values):
    v = sorted(values)
    if len(v) < 3:
        return statistics.median(v)
    cost = lambda x: sum((a - sum(x) / len(x)) ** 2 for a in x)
    k = min(range(1, len(v)), key=lambda i: cost(v[:i]) + cost(v[i:]))
    return (sum(v[:k]) / k + sum(v[k:]) / (len(v) - k)) / 2


def test_adaptive_threshold(spark):
    rng = random.Random(1)
    groups = [[rng.random() ** rng.choice([1, 3]) for _ in range(rng.randrange(1, 30))] for _ in range(120)] + [[0.3] * 5, [0.1], [0.1, 0.9], [0.2, 0.2]]
    df = spark.createDataFrame([(g, p, x) for g, xs in enumerate(groups) for p, x in enumerate(xs)], "g int, page_number int, similarity double")
    got = {r.g: r.threshold for r in similarity.adaptive_threshold(df, ("g",)).collect()}
    for g, xs in enumerate(groups):
        assert got[g] == pytest.approx(two_means(xs)) and min(xs) <= got[g] <= max(xs)
    pages = similarity.similar_pages(df, ("g",)).filter("g >= 120").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in pages} == {120: 5, 121: 1, 122: 1, 123: 2}


@pytest.mark.parametrize("block", [3, 1024])
def test_page_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(2)
    q = [(d, k, [float(x) for x in rng.normal(size=4)]) for d in range(3) for k in (1, 1, 2, 5)]
    p = [(d, n, [float(x) for x in rng.normal(size=4)] if n != 3 else None) for d in range(1, 4) for n in (1, 1, 2, 3)]
    got = similarity.page_similarity(spark.createDataFrame(q, "doc_id int, query int, vector array<double>"), spark.createDataFrame(p, "doc_id int, page_number int, vector array<double>"))
    want = {}
    for d, k, v in q:
        for e, n, w in p:
            if d == e:
                s = float(np.dot(v, w)) if w else 0.0
                want[d, k, n] = max(s, want.get((d, k, n), -9))
    assert {(r.doc_id, r["query"], r.page_number): r.similarity for r in got.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    top = similarity.top_k_by_vector(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query int, vector array<double>"), spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(8)] + [(9, None)], "ord long, vector array<double>"), 4)
    assert {(r["query"], r["rank"]): r.ord for r in top.collect()} == {(1, 1): 7, (1, 2): 6, (1, 3): 5, (1, 4): 4, (2, 1): 5, (2, 2): 2, (2, 3): 7, (2, 4): 4}


def test_top_k_by_terms(spark):
    q = spark.createDataFrame([(1, "A b c"), (2, "zz"), (3, "")], "query int, text string")
    d = spark.createDataFrame([(0, "x"), (1, "a B"), (2, "a a b"), (3, "c b a"), (4, None)], "ord long, content string")
    got = {(r["query"], r["rank"]): (r.ord, r.overlap) for r in similarity.retrieve(q, d, 3).collect()}
    assert got == {(1, 1): (3, 3), (1, 2): (1, 2), (1, 3): (2, 2), (2, 1): (0, 0), (2, 2): (1, 0), (2, 3): (2, 0), (3, 1): (0, 0), (3, 2): (1, 0), (3, 3): (2, 0)}


def tiers(a, b, c):
    if a & b & c:
        return {p: ("high", "ABC") for p in a & b & c}
    name, best = max((("AB", a & b), ("AC", a & c), ("BC", b & c)), key=lambda x: len(x[1]))
    return {p: ("medium", name) for p in best} if best else {p: ("low", "B") for p in b}


def test_combine(spark):
    rng = random.Random(3)
    sets = [[{rng.randrange(6) for _ in range(rng.randrange(0, 4))} for _ in "abc"] for _ in range(150)]
    frames = [spark.createDataFrame([(g, p) for g, s in enumerate(sets) for p in s[i]], "g int, page_number int") for i in range(3)]
    got = {}
    for r in attribution.combine(*frames, ("g",)).collect():
        got.setdefault(r.g, {})[r.page_number] = (r.confidence, "".join(r.methods))
    for g, s in enumerate(sets):
        assert got.get(g, {}) == tiers(*s)
    assert [r.pages for r in attribution.high_confidence(attribution.combine(*frames, ("g",)), ("g",)).collect()]


def test_entities_and_citations(spark):
    rows = spark.createDataFrame([(1, "A", "covers 45% by 2030", " "), (1, "B", "no number", "level 3")], "doc_id int, category string, response string, scoring_reasoning string")
    pages = spark.createDataFrame([(1, 1, "45 % of all"), (1, 2, "nothing"), (1, 3, "in 2030; level 3"), (2, 1, "45%")], "doc_id int, page_number int, text string")
    texts = attribution.fields(rows)
    assert texts.count() == 3
    found = attribution.entity_pages(texts, pages)
    assert {(r.category, r.field, r.page_number) for r in found.collect()} == {("A", "response", 1), ("A", "response", 3), ("B", "scoring_reasoning", 3)}
    refs = attribution.combine(found, found, found)
    assert {r.category: (r.response_page_citations, r.scoring_reasoning_page_citations) for r in attribution.cite(rows, refs).collect()} == {"A": ([1, 3], []), "B": ([], [3])}


def test_votes(spark):
    assert spark.range(1).select(attribution.temperatures()).first()[0] == pytest.approx([0.8, 0.9, 1.0])
    assert spark.range(1).select(attribution.temperatures(1)).first()[0] == [0.8]

    def broken(prompt, temperature, top_p):
        if "Page 2" in prompt:
            raise OSError("gone")
        return "YES" if temperature < 0.95 else "no"

    texts = spark.createDataFrame([(1, "A", "response", "t")], "doc_id int, category string, field string, text string")
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, " ")], "doc_id int, page_number int, text string")
    near = spark.createDataFrame([(1, "A", "response", p, 0.5) for p in (1, 2, 3)], "doc_id int, category string, field string, page_number int, similarity double")
    assert [r.page_number for r in attribution.voted_pages(texts, pages, near, broken).collect()] == [1]


def test_generation_retries_and_stub(spark):
    good = json.dumps({"response": "r" * 60, "score": 4, "scoring_reasoning": "s" * 40, "category": "other"})

    def model(prompt, temperature, top_p):
        if prompt == "fenced":
            return f"Here:\n```json\n{good}\n```"
        if prompt == "broken":
            raise OSError("refused")
        return {"good": good, "short": '{"response": "r", "score": 1, "scoring_reasoning": "s"}', "list": "[1]"}[prompt]

    df = spark.createDataFrame([(p, p) for p in ("good", "fenced", "broken", "short", "list")], "category string, prompt string")
    got = {r.category: r for r in generation.analyse(df, model, wait=lambda s: None).collect()}
    assert got["good"].score == got["fenced"].score == 4 and got["good"].error is None
    assert all(got[c].score == 0 and got[c].error and got[c].response == f"No usable reply on {c} in 3 tries." for c in ("broken", "short", "list"))
    e = generation.embed(spark.createDataFrame([("a b",), (None,)], "text string"), HashedTerms(8)).collect()
    assert len(e[0].vector) == 8 and e[1].vector is None


def test_remediation_bound(spark):
    rows = spark.createDataFrame([(i, 0, i == 0) for i in range(4)], "i int, tries int, passed boolean")
    again = lambda df: df.select("i", (F.col("tries") + 1).alias("tries"), (F.col("i") <= F.col("tries") + 1).alias("passed"))
    assert {r.i: (r.tries, r.passed) for r in remediate(rows, again).collect()} == {0: (0, True), 1: (1, True), 2: (2, True), 3: (3, True)}
    never = lambda df: df.withColumn("tries", F.col("tries") + 1)
    assert {r.i: r.tries for r in remediate(rows, never).collect()} == {0: 0, 1: 3, 2: 3, 3: 3}


def test_file_report(spark):
    full = [{"category": c, **{f: None for f in validate.REQUIRED_FIELDS if f != "category"}} for c in rubrics.names()]
    files = {"full.json": full, "twice.json": full + full[:2], "extra.json": [*full, full[0] | {"category": "More"}], "gap.json": [{"category": "Health"}, *full[1:]], "empty.json": [], "null.json": None, "number.json": [None, 1, {"score": 1}]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in files.items()] + [("bad.json", "{"), ("keys.json", json.dumps(full)[:-1] + ', {"category": "a", "category": "Health"}]')], "filename string, raw string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    got = {r.filename: r for r in validate.file_report(df).collect()}
    assert {k for k, r in got.items() if r.is_valid} == {"full.json", "extra.json", "gap.json"}
    assert got["twice.json"].duplicate_categories == sorted(rubrics.names()[:2]) and got["extra.json"].extra_categories == ["More"]
    assert got["gap.json"].categories_missing_fields[0].missing_fields == validate.REQUIRED_FIELDS[1:] and got["keys.json"].duplicate_categories == ["Health"]
    assert len(got["empty.json"].missing_categories) == 76 and got["null.json"].errors == ["JSON root is not a list/array"] and got["bad.json"].errors == ["JSON parsing error"]
    assert got["number.json"].errors == ["Entry 0 is not a dictionary", "Entry 1 is not a dictionary", "Entry 2 missing 'category' field"]
    assert validate.folder_summary(validate.file_report(df)).first().asDict() == {"n_files": 9, "n_complete": 3}


def test_stub_replies_repeat():
    g = FixedReplies(("YES", "NO"))
    assert g("p", 0.8, 0.9) == g("p", 0.8, 0.9)

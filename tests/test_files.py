"""Folders of files: reading, export, checkpoints, streams, the pipeline and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from rubrica import cli, pipeline, rubrics
from rubrica.operators import scores
from rubrica.providers import HashedTerms
from rubrica.settings import Quality, Settings
from rubrica.sources import analyses, pages, sinks
from rubrica.streaming import arrivals


def entry(category, score=3, **more):
    return {"category": category, "response": 'a "quoted", text\nand a line', "response_page_citations": [2, 10], "score": score, "scoring_reasoning": "why", "scoring_reasoning_page_citations": [], **more}


@pytest.fixture
def folder(tmp_path):
    to = tmp_path / "in"
    to.mkdir()
    (to / "Kenya_2019.json").write_text(json.dumps([entry(c, 1) for c in rubrics.names()]))
    (to / "New-Land_2021_2031.json").write_text(json.dumps([entry("Health", 5), entry("Vision", "2"), {"score": None}]))
    (to / "Bad_2000.json").write_text("{")
    (to / "Other_2001.json").write_text('{"a": 1}')
    (to / "notes.txt").write_text("[]")
    return str(to)


def test_reading(spark, folder):
    found = analyses.files(spark, folder)
    assert found.count() == 4
    rows = analyses.entries(found)
    assert {(r.country, r.year): r["count"] for r in rows.groupBy("country", "year").count().collect()} == {("Kenya", "2019"): 76, ("New Land", "2021-2031"): 3}
    assert {r.filename for r in analyses.unreadable(found).collect()} == {"Bad_2000.json", "Other_2001.json"}
    facts = analyses.facts(rows)
    assert {(r.category, r.score) for r in facts.filter("country = 'New Land'").collect()} == {("Health", 5.0), ("Vision", 2.0), ("", 0.0)}
    assert scores.summary(facts, plan=("filename",)).first().total_plans == 2


def test_export(spark, folder, tmp_path):
    assert sinks.export_csv(spark, folder, str(tmp_path / "out.csv")) == 79
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out.csv"))
    assert rows.columns == sinks.CSV_COLUMNS
    first = rows.first()
    assert (first.country, first.response, first.response_page_citations, first.score) == ("Kenya", 'a "quoted", text\nand a line', "2, 10", "1")
    assert sinks.export_both(spark, folder, str(tmp_path / "both")) == (79, 76)
    assert sinks.export_csv(spark, str(tmp_path / "both"), str(tmp_path / "none.csv")) == 0 and not (tmp_path / "none.csv").exists()


def test_rubric_file(spark, tmp_path):
    rows = [{"category": "A", "definition": "d", "indicators": ["i"]}, {"category": "B"}]
    for k, x in enumerate((rows, {"framework": rows})):
        (tmp_path / f"{k}.txt").write_text(json.dumps(x))
        got = analyses.rubric_entries(spark, str(tmp_path / f"{k}.txt")).orderBy("ordinal").collect()
        assert [(r.category, r.definition, r.indicators, r.scoring_definitions) for r in got] == [("A", "d", ["i"], []), ("B", "", [], [])]
    (tmp_path / "no.txt").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        analyses.rubric_entries(spark, str(tmp_path / "no.txt"))


def test_checkpoint(spark, tmp_path):
    keep = sinks.Checkpoint(spark, str(tmp_path), Settings().digest())
    wanted = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "doc_id int, category string")
    assert keep.left(wanted).count() == 3
    keep.add(wanted.limit(2))
    keep.add(wanted.limit(0))
    assert keep.left(wanted).count() == 1
    assert sinks.Checkpoint(spark, str(tmp_path), Settings.for_cardiovascular().digest()).left(wanted).count() == 3


def test_settings(tmp_path):
    s = Settings.for_cancer(quality=Quality(composite_threshold=0.5))
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s and Settings.load(str(tmp_path / "s.json"), domain="cvd").domain == "cvd"
    assert s.digest() != Settings().digest() == Settings.for_cancer().digest() and len(s.digest()) == 16


def lines(content):
    if content == b"bad":
        raise ValueError("no document")
    return [(t, None, None, None) for t in content.decode().split("\f")]


def test_pages(spark):
    docs = spark.createDataFrame([("a", bytearray(b"TITLE\n+-+\fsecond page")), ("b", bytearray(b"bad"))], "doc_id string, content binary")
    got = pages.extract(docs, lines)
    rows = {(r.doc_id, r.page_number): r for r in got.collect()}
    assert rows["a", 1].html == "<h1>TITLE</h1>\n<p>+-+</p>" and rows["a", 1].has_tables and not rows["a", 2].has_tables and rows["a", 2].word_count == 2 and rows["a", 1].confidence == 0.9
    assert rows["b", None].error == "ValueError: no document" and rows["b", None].confidence is None
    assert pages.full_text(got).first().full_text == "--- PAGE 1 ---\nTITLE\n+-+\n\n--- PAGE 2 ---\nsecond page"
    assert {r.doc_id: r.text for r in pages.page_text(got, 2).collect()} == {"a": "second page", "b": ""}
    assert json.loads(pages.serialised(got.filter("error IS NULL")).first().json)["total_pages"] == 2


def reply(prompt, temperature, top_p):
    if prompt.startswith("Decide"):
        return "YES"
    if "Vision" in prompt.partition("### Definition")[0]:
        raise OSError("refused")
    return json.dumps({"response": "This plan covers 45% of people by 2030. " * 8, "score": 4, "scoring_reasoning": "The evidence on 45% is stated in the plan itself. " * 5})


def run(spark, tmp_path, **how):
    docs = spark.createDataFrame([("d1", 1, "The plan covers 45% of people."), ("d1", 2, "Other words."), ("d2", 1, "")], "doc_id string, page_number int, text string")
    entries = spark.createDataFrame([(0, "Health", "People covered", ["people"], ["0 none"]), (1, "Vision", "", [], [])], "ordinal int, category string, definition string, indicators array<string>, scoring_definitions array<string>")
    from rubrica.settings import Generation

    return pipeline.process(docs, entries, reply, HashedTerms(), Settings(generation=Generation(retry_delay=0)), **how)


def test_pipeline(spark, tmp_path):
    keep = sinks.Checkpoint(spark, str(tmp_path / "keep"), "x")
    out = run(spark, tmp_path, checkpoint=keep)
    rows = {(r.doc_id, r.category): r for r in out["analyses"].collect()}
    assert len(rows) == 4
    assert rows["d1", "Health"].score == 4 and rows["d1", "Health"].response_page_citations == [1]
    assert rows["d1", "Vision"].score == 0 and "OSError" in rows["d1", "Vision"].error
    assert {r.doc_id: r.failed_categories for r in out["report"].collect()}["d1"] == ["Vision"]
    assert {r.confidence for r in out["references"].filter("doc_id = 'd1' AND category = 'Health'").collect()} <= {"medium", "low"}
    assert keep.done().count() == 4
    again = run(spark, tmp_path, checkpoint=keep)
    assert again["analyses"].count() == 4 and keep.done().count() == 4
    named = out["analyses"].withColumns({"country": F.concat(F.lit("Land "), "doc_id"), "year": F.lit("2021-2031")})
    sinks.write_json(sinks.as_json(named), str(tmp_path / "json"))
    files = sorted(p.name for p in (tmp_path / "json").glob("*.json"))
    assert files == ["Land_d1_2021_2031.json", "Land_d2_2021_2031.json"]
    back = json.loads((tmp_path / "json" / files[0]).read_text())
    assert [x["category"] for x in back] == ["Health", "Vision"] and list(back[0]) == sinks.FIELDS


def test_streams(spark, folder, tmp_path):
    q = arrivals.validated(spark, folder, str(tmp_path / "report"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert {r.filename: r.is_valid for r in spark.read.parquet(str(tmp_path / "report")).collect()} == {"Kenya_2019.json": True, "New-Land_2021_2031.json": False, "Bad_2000.json": False, "Other_2001.json": False}
    q = arrivals.running_means(spark, folder).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n_scores) FROM means").first()[0] == 78
    q = arrivals.exported(spark, folder).writeStream.format("memory").queryName("rows_").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rows_").count() == 79


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["validate", "--folder", folder, "--output", str(tmp_path / "v")]) == 0
    said = capsys.readouterr().out
    assert "Kenya_2019.json: COMPLETE (76/76)" in said and "1/4 complete" in said and "and 69 more" in said
    assert cli.main(["export", "--folder", folder, "--output", str(tmp_path / "e"), "--commonwealth"]) == 0
    assert "all 79, filtered 76" in capsys.readouterr().out
    assert cli.main(["summary", "--folder", folder, "--output", str(tmp_path / "s.json")]) == 0
    stats = json.loads((tmp_path / "s.json").read_text())
    assert stats["total_plans"] == 2 and len(stats["highest_sections"]) == 3 and list(stats["section_medians"])[0] == stats["highest_sections"][0]["section"]
    assert cli.parser().parse_args(["batch", "--input-dir", "x"]).input_dir == "x"


def test_rendered_pages_in_batches():
    import numpy as np

    sizes, made = [], []

    def read(images):
        sizes.append(len(images))
        return [f"{x.shape} {x.max()}" for x in images]

    def missing(content, dpi):
        raise ImportError("no renderer")
        yield

    def render(content, dpi):
        for k in range(len(content)):
            made.append(k)
            yield np.zeros((2, 3, 4), np.uint8) if k % 2 else np.full((2, 3), 7, np.uint8)

    found = pages.Rendered(read, batch=2, renderers=(missing, render))(b"abcde")
    assert sizes == [2, 2, 1] and [x[0] for x in found] == ["(2, 3, 3) 7", "(2, 3, 3) 255"] * 2 + ["(2, 3, 3) 7"]
    half = pages.rgb(np.array([[[0, 0, 0, 128]]], np.uint8))
    assert half.shape == (1, 1, 3) and half.max() == half.min() == 127
    assert pages.Rendered(read, renderers=(missing, render), prepare=lambda x: x[:1])(b"a")[0][0] == "(1, 3, 3) 7"
    try:
        pages.Rendered(read, renderers=(missing,))(b"a")
        raise AssertionError
    except ImportError:
        pass


def test_quality_report_json(spark):
    from rubrica.operators import quality

    rows = [("d", 1, "b", 0.123456, 0.5, 1.0, 1.0, 0.65586, False, ["x"]), ("d", 0, "a", 1.0, 1.0, 1.0, 1.0, 1.0, True, [])]
    df = spark.createDataFrame(rows, "doc_id string, ordinal int, category string, readability double, coherence double, coverage double, compliance double, composite double, passed boolean, issues array<string>")
    got = json.loads(quality.report_json(df).first().json)
    assert got["pass_rate"] == 0.5 and got["overall_composite"] == 0.8279 and got["failed_categories"] == ["b"] and got["total_issues"] == 1
    assert [x["category"] for x in got["scores"]] == ["a", "b"] and got["scores"][1]["readability"] == 0.1235 and got["scores"][1]["schema_compliance"] == 1.0


def test_prompts_ask_by_vectors(spark):
    entries = spark.createDataFrame([(0, "alpha plan", "what alpha is", ["alpha one"], []), (1, "beta plan", "what beta is", [], ["beta zero"])], "ordinal int, category string, definition string, indicators array<string>, scoring_definitions array<string>")
    docs = spark.createDataFrame([("d", "some text")], "doc_id string, full_text string")
    for embedder in (None, HashedTerms()):
        got = {r.category: r.prompt for r in pipeline.prompts(docs, entries, Settings(), embedder).collect()}
        assert set(got) == {"alpha plan", "beta plan"} and all("some text" in p and "Category: " in p for p in got.values())

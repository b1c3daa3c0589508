"""Texts of files are made and parsed once; the kind of root is told without a schema."""

import pytest

from rubrica.plans import registry
from rubrica.sources import analyses

from .test_plans import SF


@pytest.mark.parametrize("name", ["validate_report", "export_rows", "unreadable_files"])
def test_files_are_parsed_once(spark, name):
    text = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "schema_of_variant" not in text and "schemaofvariant" not in text
    assert text.count("parse_json") + text.count("parsejson") == 1


def test_kinds_of_roots(spark):
    rows = [("a", " \n\t[1, {}]"), ("b", "{}"), ("c", "3"), ("d", "[1"), ("e", None), ("f", "[]"), ("g", '"[x]"')]
    df = spark.createDataFrame(rows, "filename string, raw string")
    assert {r.filename: r.error for r in analyses.unreadable(df).collect()} == {"b": "JSON root is not a list/array", "c": "JSON root is not a list/array", "d": "JSON parsing error", "e": "JSON parsing error", "g": "JSON root is not a list/array"}
    assert sorted((r.filename, r.position) for r in analyses.entries(df).collect()) == [("a", 0), ("a", 1)]

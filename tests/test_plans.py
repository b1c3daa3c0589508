"""Plans: only needed columns are read, filters reach the scan, the rubric is broadcast, no Python where expressions do."""

import contextlib
import io
import re

import pytest

from rubrica.plans import registry

SF = "/root/testdata/sf0.001"
WITH_PYTHON = {"semantic_page_max", "adaptive_threshold", "semantic_match", "prefilter_p25", "topk_semantic", "attribution_tiers"}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def read_columns(text: str) -> dict[str, set]:
    out = {}
    for m in re.finditer(r"Location: InMemoryFileIndex \[[^\]]*?/(\w+)\.parquet\](.*?)ReadSchema: struct<([^\n]*)>", text, re.S):
        out.setdefault(m[1], set()).update(re.findall(r"(?:^|,)(\w+):", m[3]))
    return out


@pytest.mark.parametrize("name", ["section_scores", "overall_median", "word_counts", "entities_basic", "majority_vote", "country_year_parse"])
def test_only_needed_columns_are_read(spark, name):
    got = read_columns(plan(registry.queries()[name](spark, SF)))
    want = {
        "section_scores": {"nation": {"n_nationkey", "n_name"}, "customer": {"c_custkey", "c_nationkey"}, "orders": {"o_orderkey", "o_custkey", "o_orderdate"}},
        "overall_median": {"lineitem": {"l_orderkey", "l_partkey", "l_quantity"}},
        "word_counts": {"documents": {"doc_id", "text"}},
        "entities_basic": {"orders": {"o_orderkey", "o_orderdate"}},
        "majority_vote": {"events": {"event_id", "event_type"}},
        "country_year_parse": {"orders": {"o_custkey", "o_orderdate"}},
    }[name]
    for table, columns in want.items():
        assert got[table] == columns


def test_rubric_is_broadcast_and_sums_are_partial(spark):
    text = plan(registry.queries()["section_scores"](spark, SF))
    assert "BroadcastHashJoin" in text and "partial_" in text and "CartesianProduct" not in text


def test_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    text = plan(registry.queries()["majority_vote"](spark, SF).filter(F.col("query") == 7))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,7)]" in text


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - WITH_PYTHON - {"remediation_loop"}))
def test_no_python_in_the_plan(spark, name):
    assert not re.search("EvalPython|PythonUDF|InPandas|InArrow|CartesianProduct", plan(registry.queries()[name](spark, SF)))

"""Entities of many pages: parts grow in number, not in size; a page's entities are found once and stay together until they are counted."""

import re

from pyspark.sql import functions as F

from rubrica import common
from rubrica.functions import entities as E
from rubrica.plans import fixtures, registry

from .test_plans import SF, plan


def test_parts_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_ROWS", 500)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fixtures.narrative(spark, SF).rdd.getNumPartitions() == -(-rows // 500)  # the session's number before
    text = plan(registry.queries()["entities_context_int"](spark, SF))
    assert len(re.findall(r"\n\(\d+\) Exchange", text)) <= 2  # lines and orders; what was found is not sent again


def test_pages_are_merged_whole(spark):
    rows = spark.createDataFrame([(1, 1, "a b a"), (1, 1, "b c"), (1, 2, "a"), (2, 1, "")], "doc_id int, page_number int, text string")
    found = registry._of_pages(rows, F.array_distinct(F.filter(F.split("text", " "), lambda x: x != "")))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, 2, "a")]


def test_no_filter_looks_for_entities(spark):
    for part in plan(registry.queries()["entity_page_match"](spark, SF)).split("\n\n"):
        if re.match(r"\(\d+\) Filter", part):
            assert "regexp" not in part


def test_ascii_finds_the_same(spark):
    texts = ["In Stage 3, 5 % of $1,200 Million by 2031; 12.5% and 007", "USD 5 , then level\x1c4", "9 " + "x" * 50 + " TARGET 8", "£5 b ¥7 ", ""]
    df = spark.createDataFrame([(t, t + "٣é") for t in texts], "a string, u string")
    for of in (E.percentages, E.years, E.money, E.grouped_numbers, E._small):
        for r in df.select(of(F.concat("a", F.lit(" ."))).alias("a"), of(F.concat("a", F.lit(" é"))).alias("u")).collect():
            assert r.a == r.u

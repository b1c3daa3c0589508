"""Validation of analysis files against a rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rubrics
from ..sources.analyses import is_list

# Fields that every entry must have, null or not.
REQUIRED_FIELDS = ["category", "response", "response_page_citations", "score", "scoring_reasoning", "scoring_reasoning_page_citations"]


def file_report(files: DataFrame, domain: str = "cancer") -> DataFrame:
    """files: filename, raw. One row per file: is_valid, total_categories, expected_categories, missing, extra and duplicate categories,
    categories_missing_fields, errors. Files that can't be read are rows with an error.

    A file is valid without missing or duplicate categories and errors; extra categories and missing fields don't count.
    """
    need = rubrics.names(domain)
    root = files.select("filename", F.try_parse_json("raw").alias("root"), is_list(F.col("raw")).alias("listed"))
    root = root.withColumn("shape", F.when(F.col("root").isNull(), "bad").when(F.col("listed"), "list").otherwise("other"))
    items = root.select("filename", "shape", F.when(F.col("shape") == "list", F.try_variant_get("root", "$", "array<variant>")).alias("items"))
    as_map = F.transform("items", lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    entry = items.withColumn("maps", as_map)

    def judged(m, i):
        keys = F.map_keys(m)
        named = F.coalesce(F.array_contains(keys, "category"), F.lit(False))
        error = F.when(m.isNull(), F.format_string("Entry %d is not a dictionary", i)).when(~named, F.format_string("Entry %d missing 'category' field", i))
        category = F.when(named, F.try_variant_get(m["category"], "$", "string"))
        return F.struct(category.alias("category"), F.when(named, F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), keys)).alias("lacks"), error.alias("error"))

    rows = entry.withColumn("judged", F.transform("maps", judged))
    some = lambda x: F.filter(x, lambda y: y.isNotNull())
    rows = rows.select(
        "filename", "shape", F.coalesce(F.size("items"), F.lit(0)).alias("n"),
        F.sort_array(some(F.transform("judged", lambda j: j["category"]))).alias("found"),
        F.transform(F.filter("judged", lambda j: F.size(j["lacks"]) > 0), lambda j: F.struct(j["category"].alias("category"), j["lacks"].alias("missing_fields"))).alias("gaps"),
        some(F.transform("judged", lambda j: j["error"])).alias("wrong"),
    )
    text = F.array().cast("array<string>")
    found, names = F.coalesce("found", text), F.array(*map(F.lit, need))
    once = F.array_distinct(found)
    listed = F.col("shape") == "list"
    twice = F.filter(F.transform(found, lambda x, i: F.when((i > 0) & (x == F.try_element_at(found, i)), x)), lambda x: x.isNotNull())
    error = F.when(F.col("shape") == "bad", F.array(F.lit("JSON parsing error"))).when(~listed, F.array(F.lit("JSON root is not a list/array"))).otherwise(F.coalesce("wrong", text))
    out = rows.select(
        "filename", F.when(listed, F.col("n")).otherwise(0).alias("total_categories"), F.lit(len(need)).alias("expected_categories"),
        F.when(listed, F.array_sort(F.array_except(names, once))).otherwise(text).alias("missing_categories"), F.when(listed, F.array_sort(F.array_except(once, names))).otherwise(text).alias("extra_categories"),
        F.when(listed, F.array_distinct(twice)).otherwise(text).alias("duplicate_categories"), F.coalesce("gaps", F.array().cast("array<struct<category:string,missing_fields:array<string>>>")).alias("categories_missing_fields"), error.alias("errors"),
    )
    return out.withColumn("is_valid", (F.size("missing_categories") == 0) & (F.size("duplicate_categories") == 0) & (F.size("errors") == 0))


def missing_categories(facts: DataFrame, plan: tuple, domain: str = "cancer") -> DataFrame:
    """plan columns, category: elements of the rubric that a plan lacks. An anti-join, for any number of plans."""
    dim = rubrics.dimension(facts.sparkSession, domain).select("category")
    return facts.select(*plan).distinct().crossJoin(dim).join(facts.select(*plan, "category"), [*plan, "category"], "left_anti")


def duplicate_categories(facts: DataFrame, plan: tuple) -> DataFrame:
    return facts.groupBy(*plan, "category").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def folder_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_files"), F.count_if("is_valid").alias("n_complete"))

"""Rubric texts: definitions, indicators, scoring criteria; knowledge base and prompt context made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "ordinal int, category string, definition string, indicators array<string>, scoring_definitions array<string>"


def complete(entries: DataFrame) -> DataFrame:
    """Entries with what is missing as empty."""
    none = F.array().cast("array<string>")
    return entries.select("ordinal", "category", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("indicators", none).alias("indicators"), F.coalesce("scoring_definitions", none).alias("scoring_definitions"))


def latest(entries: DataFrame) -> DataFrame:
    """One entry per category, the last one."""
    rest = [c for c in entries.columns if c != "category"]
    best = entries.groupBy("category").agg(F.max_by(F.struct(*rest), "ordinal").alias("best"))
    return best.select("category", *[F.col(f"best.{c}").alias(c) for c in rest])


def _list(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- "), x))


def knowledge_base(entries: DataFrame) -> DataFrame:
    """ord, content, category, type: a document with definition and indicators for each entry, one with its criteria if it has any."""
    e = complete(entries)
    some = F.size("indicators") > 0
    definition = F.concat(
        F.lit("Category: "), "category", F.lit("\n\nDefinition: "), "definition", F.when(some, F.concat(F.lit("\n\nRecommended Indicators:\n"), F.array_join(_list(F.col("indicators")), "\n"))).otherwise("")
    )
    criteria = F.concat(F.lit("Scoring Rubric for "), "category", F.lit(":\n\n"), F.array_join("scoring_definitions", "\n"))
    both = F.array(F.struct(definition.alias("content"), F.lit("definition").alias("type")), F.when(F.size("scoring_definitions") > 0, F.struct(criteria.alias("content"), F.lit("scoring_rubric").alias("type"))))
    rows = e.select("ordinal", "category", F.posexplode(both).alias("part", "doc")).filter("doc IS NOT NULL")
    return rows.select((F.col("ordinal") * 2 + F.col("part")).cast("long").alias("ord"), "doc.content", "category", "doc.type")


def prompt_context(entries: DataFrame) -> DataFrame:
    """category, context: the entry as it goes into a prompt."""
    e = complete(entries)

    def block(title: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"\n### {title}")), _list(F.col(items)))).otherwise(F.array().cast("array<string>"))

    head = F.array(F.concat(F.lit("## Sub-Element: "), "category"), F.concat(F.lit("\n### Definition\n"), "definition"))
    return e.select("category", F.array_join(F.concat(head, block("Recommended Indicators", "indicators"), block("Scoring Criteria", "scoring_definitions")), "\n").alias("context"))

"""Scores of plans: by section, overall, across plans.

Facts are rows (plan columns, category, score, position); a plan's columns are named in ``plan``. All joins are with the
rubric's dimension, of at most 76 rows, and aggregate before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rubrics

PLAN = ("country", "year")


def last_of_duplicates(facts: DataFrame, plan: tuple = PLAN, order: str = "position") -> DataFrame:
    """Of rows that share a plan and a category, the one with the greatest position."""
    keys = [*plan, "category"]
    rest = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def section_scores(facts: DataFrame, domain: str = "cancer", plan: tuple = PLAN) -> DataFrame:
    """Mean normalised score of every section of every plan; 0 for a section without any. The last duplicate counts."""
    spark = facts.sparkSession
    dim = rubrics.dimension(spark, domain)
    own = last_of_duplicates(facts, plan).join(dim, "category")
    own = own.groupBy(*plan, "section_ord").agg(F.avg(rubrics.normalised(F.col("score"), F.col("max_score"))).alias("mean"))
    names = [s for s, *_ in rubrics.sections(domain)]
    wide = facts.select(*plan).distinct().join(own, list(plan), "left").groupBy(*plan).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("section_ord", "mean")), lambda x: x["section_ord"].isNotNull())).alias("means"))
    rows = wide.select(*plan, "means", F.posexplode(F.array(*map(F.lit, names))).alias("section_ord", "section"))
    return rows.select(*plan, "section_ord", "section", F.coalesce(F.try_element_at("means", "section_ord"), F.lit(0.0)).alias("score"))


def known_scores(facts: DataFrame, domain: str = "cancer") -> DataFrame:
    """Rows of elements that the rubric has, with section, section_ord and norm. All duplicates count."""
    return facts.join(rubrics.dimension(facts.sparkSession, domain), "category").withColumn("norm", rubrics.normalised(F.col("score"), F.col("max_score")))


def overall_scores(facts: DataFrame, domain: str = "cancer", plan: tuple = PLAN) -> DataFrame:
    """Median of each plan's normalised scores; 0 for a plan without a known element."""
    dim = rubrics.dimension(facts.sparkSession, domain)
    norm = F.when(F.col("max_score").isNotNull(), rubrics.normalised(F.col("score"), F.col("max_score")))
    return facts.join(dim, "category", "left").groupBy(*plan).agg(F.coalesce(F.median(norm), F.lit(0.0)).alias("overall"), F.count(norm).alias("n_scores"))


def comparison(facts: DataFrame, domain: str = "cancer", plan: tuple = PLAN) -> DataFrame:
    """One row per plan, a column for each section; ``label`` is "country (year)"."""
    names = [s for s, *_ in rubrics.sections(domain)]
    wide = section_scores(facts, domain, plan).groupBy(*plan).pivot("section", names).agg(F.first("score"))
    return wide.withColumn("label", F.concat(plan[0], F.lit(" ("), plan[1], F.lit(")")))


def section_medians(facts: DataFrame, domain: str = "cancer") -> DataFrame:
    """Median, mean and number of the pooled scores of each section that has any, with its rank from both ends (ties: rubric order)."""
    own = known_scores(facts, domain).groupBy("section_ord", "section").agg(F.median("norm").alias("median"), F.avg("norm").alias("mean"), F.count("norm").alias("n_scores"))
    one = Window.partitionBy()  # at most 12 rows
    down = one.orderBy(F.desc("median"), F.asc("section_ord"))
    return own.withColumn("rank", F.row_number().over(down)).withColumn("from_end", F.count(F.lit(1)).over(one) - F.col("rank") + 1)


def top_and_bottom(facts: DataFrame, domain: str = "cancer", n: int = 3) -> DataFrame:
    """The sections with the n highest and the n lowest medians, both lists from high to low."""
    ranked = section_medians(facts, domain)
    high = ranked.filter(F.col("rank") <= n).select(F.lit("highest").alias("list"), "rank", "section", "median")
    low = ranked.filter(F.col("from_end") <= n).select(F.lit("lowest").alias("list"), (n + 1 - F.col("from_end")).alias("rank"), "section", "median")
    return high.union(low)


def summary(facts: DataFrame, domain: str = "cancer", plan: tuple = PLAN) -> DataFrame:
    """One row: number of plans, median and mean of their overall scores."""
    return overall_scores(facts, domain, plan).agg(F.count(F.lit(1)).alias("total_plans"), F.median("overall").alias("median_overall"), F.avg("overall").alias("mean_overall"))

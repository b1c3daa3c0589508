"""What was assessed is written once; passed and failed rows are both read from there."""

from pyspark.sql import functions as F

from rubrica.operators import remediation


def test_each_round_is_staged_once(spark, monkeypatch):
    calls, real = [], remediation.staged
    monkeypatch.setattr(remediation, "staged", lambda df, name: calls.append(1) or real(df, name))
    rows = spark.range(6).select("id", F.lit(0).alias("round"), (F.col("id") < 2).alias("passed"))
    found = remediation.remediate(rows, lambda df: df.select("id", (F.col("round") + 1).alias("round"), (F.col("id") < 4).alias("passed")))
    assert sorted((r.id, r["round"], r.passed) for r in found.collect()) == [(0, 0, True), (1, 0, True), (2, 1, True), (3, 1, True), (4, 3, False), (5, 3, False)]
    assert len(calls) == 4  # the first assessment and three rounds; seven before, and passed rows were assessed again

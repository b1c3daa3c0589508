"""Bounded remediation: failed analyses are made again and assessed again, at most so many rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..common import staged
from ..settings import Quality


def remediate(assessed: DataFrame, again: Callable[[DataFrame], DataFrame], settings: Quality | None = None) -> DataFrame:
    """assessed: rows with passed. again: takes the failed ones and returns rows of the same columns, assessed anew.

    Only failed rows are made and assessed again. What was assessed, and each round, is written to the shared folder once: nothing is
    assessed or asked for twice, also when a task is lost, and plans stay short. The driver sees only whether any row failed.
    """
    s = settings or Quality()
    assessed = staged(assessed, "remediation")
    fine = [assessed.filter("passed")]
    open_ = assessed.filter("NOT passed")
    for _ in range(s.max_remediation_rounds):
        if open_.isEmpty():
            break
        made = staged(again(open_).select(*assessed.columns), "remediation")
        fine.append(made.filter("passed"))
        open_ = made.filter("NOT passed")
    out = open_
    for f in fine:
        out = out.unionByName(f)
    return out

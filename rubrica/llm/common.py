"""What the operators share: reading tables, staging in the shared folder, shipping this package to workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import bucketed, release, shared_dir, small, staged, staged_so_far  # noqa: F401  operators take them from here

#: The white space of all word contracts: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_own_caches: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers can import it from anywhere."""
    if spark.conf.get(_BATCH) == "67108864b":  # the default; texts are copied several times on their way
        spark.conf.set(_BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        to = Path(tempfile.mkdtemp()) / f"{root.name}_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def take_over(name: str, clear: Callable[[], None]) -> None:
    """Workers outlive stages: whoever fills a cache there empties those of the other operators first."""
    if name not in _own_caches:
        for f in _own_caches.values():
            f()
        _own_caches.clear()
        _own_caches[name] = clear
        tidy()


def tidy() -> None:
    """Hands memory that is free in this worker back to the machine."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(batches: Iterator) -> Iterator:
    """The batches of a task; when they end, the worker keeps no more memory than its caches."""
    try:
        yield from batches
    finally:
        tidy()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever the case of its letters."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = n
        while k.lower() in there:
            k += "_"
        there.add(k.lower())
        out.append(k)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(column: Column) -> Column:
    """Without any of the six white-space characters."""
    for c in SPACE:
        column = F.replace(column, F.lit(c), F.lit(""))
    return column


def environ_single_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")

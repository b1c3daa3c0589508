"""Staging in the shared folder, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small table of numbers and texts that stands in the plan itself, so that its size is known there."""
    show = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)} AS t({', '.join(columns)})")


#: Rows of a few short columns that may be broadcast.
BROADCAST_ROWS = 200_000
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where none is set and one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rubrica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
    """As ``staged``, in n buckets of the keys: a join on these keys sends the other side only."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    _staged.append((spark, path))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: its files are not the warehouse's
    return out


def staged_so_far() -> int:
    """A mark; ``release`` takes what was staged after it."""
    return len(_staged)


def release(mark: int = 0, until: int | None = None) -> None:
    """Deletes tables that were staged between two marks. Their frames, and what was derived from them, can't be read afterwards."""
    for i, (spark, path) in enumerate(_staged[mark:until], mark):
        if path:
            try:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's to clean then
                pass
            _staged[i] = (spark, "")


atexit.register(release)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df (staged or cheap) has at most so many rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if its size allows it; otherwise the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


#: Rows of a part, at most and at least.
MOST_ROWS, LEAST_ROWS = 1 << 18, 1 << 12


def parts(df: DataFrame) -> int:
    """Into how many parts a table is to be dealt: they grow in number, not in size; small tables have one for every core."""
    n = df.count()
    return max(-(-n // MOST_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)

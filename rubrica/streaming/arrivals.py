"""A folder of analyses as a stream: files are validated and exported as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rubrics
from ..operators.validate import file_report
from ..sources import analyses, sinks


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the export, stateless."""
    return sinks.export_rows(analyses.entries(analyses.stream_files(spark, folder)))


def running_means(spark: SparkSession, folder: str, domain: str = "cancer") -> DataFrame:
    """Number and mean of normalised scores by section, over all files so far."""
    rows = analyses.facts(analyses.entries(analyses.stream_files(spark, folder))).join(rubrics.dimension(spark, domain), "category")
    return rows.groupBy("section_ord", "section").agg(F.count(F.lit(1)).alias("n_scores"), F.avg(rubrics.normalised(F.col("score"), F.col("max_score"))).alias("mean"))


def validated(spark: SparkSession, folder: str, path: str, checkpoint: str, domain: str = "cancer") -> StreamingQuery:
    """Appends the report of each batch of new files to a Parquet folder; a batch that is done again replaces its own part."""

    def write(batch: DataFrame, epoch: int) -> None:
        file_report(batch, domain).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return analyses.stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Writing analyses: JSON per document, one CSV per folder, reports; and checkpoints of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import country_and_year
from ..rubrics import COMMONWEALTH
from . import analyses

FIELDS = ["category", "response", "response_page_citations", "score", "scoring_reasoning", "scoring_reasoning_page_citations"]
CSV_COLUMNS = ["country", "year", "Sub-Element", "response", "response_page_citations", "score", "reasoning", "scoring_reasoning_page_citations"]


def export_rows(entries: DataFrame) -> DataFrame:
    """entries: country, year, entry (variant). One row of eight texts each; what is missing is empty."""
    get = lambda name, kind="string": F.try_variant_get("entry", f"$.{name}", kind)
    text = lambda name: F.coalesce(get(name), F.lit(""))
    pages = lambda name: F.coalesce(F.array_join(F.filter(get(name, "array<string>"), lambda x: x.isNotNull()), ", "), F.lit(""))
    return entries.select(
        "country", "year", text("category").alias("Sub-Element"), text("response").alias("response"), pages("response_page_citations").alias("response_page_citations"), text("score").alias("score"), text("scoring_reasoning").alias("reasoning"), pages("scoring_reasoning_page_citations").alias("scoring_reasoning_page_citations")
    )


def only(rows: DataFrame, countries: list | set | None) -> DataFrame:
    """Rows of those countries; of all, if none are named."""
    return rows.filter(F.col("country").isin(*sorted(countries))) if countries else rows


def export_csv(spark: SparkSession, folder: str, path: str, countries: list | set | None = None) -> int:
    """One CSV file, under a folder, of all analyses of a folder, sorted by file; returns its rows. Nothing is written without any file.

    The country comes from the file's name, so a filter on it skips files before they are parsed.
    """
    found = analyses.files(spark, folder)
    if found.isEmpty():
        return 0
    if countries:
        found = found.filter(country_and_year(F.col("filename"))[0].isin(*sorted(countries)))
    rows = export_rows(analyses.entries(found).orderBy("filename", "position"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()


def countries(rows: DataFrame) -> int:
    """Number of countries in an export."""
    return rows.agg(F.countDistinct("country")).first()[0]


def export_both(spark: SparkSession, folder: str, path: str, countries: list | None = None) -> tuple[int, int]:
    """All countries, and those named (the Commonwealth's by default)."""
    return export_csv(spark, folder, f"{path}/global_analyses.csv"), export_csv(spark, folder, f"{path}/CW_analyses.csv", COMMONWEALTH if countries is None else countries)


def file_name(country: str, year: str, end: str = ".json") -> Column:
    return F.concat(F.regexp_replace(country, "[ /]", "_"), F.lit("_"), F.replace(year, F.lit("-"), F.lit("_")), F.lit(end))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the cluster's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def as_json(rows: DataFrame, keys: tuple = ("country", "year"), order: str = "ordinal") -> DataFrame:
    """keys, filename, json: each document's analyses as a JSON array in rubric order."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*FIELDS).alias("x")))).alias("all"))
    return got.select(*keys, file_name(*keys).alias("filename"), F.to_json(F.transform("all", lambda a: a["x"]), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def write_json(documents: DataFrame, folder: str) -> None:
    """documents: filename, json. One file each, written by the task that has the row, through the cluster's own file system."""
    spark = documents.sparkSession
    documents.select(F.col("json").alias("value"), F.col("filename").alias("file")).repartition("file").write.mode("overwrite").partitionBy("file").text(f"{folder}/.parts")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/.parts")
    fs = root.getFileSystem(conf)
    for d in fs.listStatus(root):  # names only: one per document of this run
        name = d.getPath().getName()
        if name.startswith("file="):
            part = next(f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-"))
            to = jvm.org.apache.hadoop.fs.Path(folder, spark._jvm.java.net.URLDecoder.decode(name[5:], "UTF-8"))
            fs.delete(to, False)
            fs.rename(part, to)
    fs.delete(root, True)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


class Checkpoint:
    """Finished analyses as Parquet under (settings, document): a later run with the same settings takes up from there."""

    def __init__(self, spark: SparkSession, folder: str, digest: str) -> None:
        self.spark, self.path = spark, f"{folder}/settings={digest}"

    def done(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.parquet(self.path) if there else None

    def left(self, wanted: DataFrame, keys: tuple = ("doc_id", "category")) -> DataFrame:
        """Rows of wanted that are not finished."""
        done = self.done()
        return wanted if done is None else wanted.join(done.select(*keys), list(keys), "left_anti")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

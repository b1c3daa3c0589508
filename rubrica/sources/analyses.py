"""Reading folders of analysis files, rubric files and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import country_and_year
from ..operators.rubric import ENTRY

LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """filename, raw of every *.json right in the folder."""
    spark.conf.set(LAST_KEY_WINS, "true")
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of arriving files."""
    spark.conf.set(LAST_KEY_WINS, "true")
    return spark.readStream.option("pathGlobFilter", "*.json").format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"))


def is_list(raw: Column) -> Column:
    """Whether the root of a text that parses as JSON is a list, by its first character: the schema of a variant would be merged from all its entries."""
    return F.coalesce(F.startswith(F.ltrim(raw, F.lit(" \t\n\r")), F.lit("[")), F.lit(False))


def entries(found: DataFrame) -> DataFrame:
    """filename, country, year, position, entry (variant) of files whose root is a list; others are skipped."""
    items = F.when(is_list(F.col("raw")), F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>"))  # no filter: it would make and parse texts twice
    country, year = country_and_year(F.col("filename"))
    return found.select("filename", country.alias("country"), year.alias("year"), F.posexplode(items).alias("position", "entry"))


def unreadable(found: DataFrame) -> DataFrame:
    """filename, error of the files that ``entries`` skips."""
    why = F.when(F.try_parse_json("raw").isNull(), "JSON parsing error").when(~is_list(F.col("raw")), "JSON root is not a list/array")
    return found.select("filename", F.explode(F.filter(F.array(why), lambda x: x.isNotNull())).alias("error"))


def facts(rows: DataFrame) -> DataFrame:
    """country, year, filename, position, category, score of entries; a missing score counts 0, as does one that is no number."""
    get = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind)
    return rows.select("country", "year", "filename", "position", F.coalesce(get("category", "string"), F.lit("")).alias("category"), F.coalesce(get("score", "double"), F.lit(0.0)).alias("score"))


def rubric_entries(spark: SparkSession, path: str) -> DataFrame:
    """Rubric file: a list, or an object with the list under "framework". Of entries with one category the last counts."""
    spark.conf.set(LAST_KEY_WINS, "true")
    root = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("root"))
    shape = F.schema_of_variant("root")
    items = F.when(shape.startswith("ARRAY"), F.try_variant_get("root", "$", "array<variant>")).otherwise(F.try_variant_get("root", "$.framework", "array<variant>"))
    made = root.select(items.alias("items"))
    first = made.first()
    if first is None or first["items"] is None:
        raise ValueError("a rubric file holds a list, or an object with a list under 'framework'")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = made.select(F.posexplode("items").alias("ordinal", "v")).select("ordinal", get("category", "string").alias("category"), get("definition", "string").alias("definition"), get("indicators", "array<string>").alias("indicators"), get("scoring_definitions", "array<string>").alias("scoring_definitions"))
    from ..operators.rubric import complete, latest

    return spark.createDataFrame(complete(latest(rows)).orderBy("ordinal").collect(), ENTRY)  # one rubric file


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, filename, country, year, content of the documents right in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    country, year = country_and_year(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".json")))
    return raw.select("path", name.alias("filename"), country.alias("country"), year.alias("year"), "content")

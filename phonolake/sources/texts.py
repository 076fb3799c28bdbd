"""Text sources: lines, manifests, transcripts, test cases, class maps, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULTS_CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, by file) and value. A file is one split here, so that its lines have numbers; such files are manifests, not data."""
    raw = spark.read.option("wholetext", True).text(path).select(F.split("value", "\r\n|\r|\n").alias("all"))
    return raw.select(F.posexplode("all").alias("line_no", "value")).select(F.col("line_no").cast("bigint"), "value")


def ground_truth(all_lines: DataFrame) -> DataFrame:
    """Trimmed lines without the blank ones; comments and mapping rows are kept."""
    return all_lines.select("line_no", F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("value")).filter(F.length("value") > 0)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """audio and reference of a JSON array."""
    return spark.read.schema("audio string, text string").option("multiLine", True).json(path).select("audio", F.col("text").alias("reference"))


CASES = "test_cases array<struct<sample_id string, case_name string, target_layer string, script_reference string, boost_keywords array<string>, itn_expected string, acoustic_friction_note string, paralinguistic_tags array<string>>>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each scripted case; keys that a case lacks are null."""
    return spark.read.schema(CASES).option("multiLine", True).json(path).select(F.explode("test_cases").alias("c")).select("c.*")


def class_map(all_lines: DataFrame, naive: bool = False) -> DataFrame:
    """class_idx and class of a CSV of index, id and name. ``naive`` splits at every comma, so that a name with one is cut."""
    rows = all_lines.filter((F.col("line_no") > 0) & (F.length(F.trim("value")) > 0))
    if naive:
        name = F.regexp_replace(F.get(F.split("value", ","), F.lit(2)), '^"+|"+$', "")
    else:
        name = F.from_csv("value", F.lit("a int, b string, c string"))["c"]
    return rows.select((F.col("line_no") - 1).cast("int").alias("class_idx"), name.alias("class"))


def results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A result table whose cells may hold line breaks and quotes."""
    reader = spark.read.options(**RESULTS_CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a small table as lines with numbers."""
    return df.withColumn("line_no", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)

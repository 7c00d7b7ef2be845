"""Readers and writers of SQL scripts and plan captures: one row a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sql import format_column, unified_diff
from tessera.shipping import ship


def read_sql_files(spark: SparkSession, path: str | list[str], pattern: str = "*.sql") -> DataFrame:
    """(path, text) of the files below a folder, or of the files named. Files in folders
    whose name starts with a dot are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.filter(~F.col("path").rlike(r"/\.[^/]+/"))


def read_plan_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, text, format): captures of EXPLAIN, text or JSON by their first character."""
    rows = read_sql_files(spark, path, pattern)
    return rows.withColumn("format", F.when(F.ltrim("text").rlike(r"^[\[{]"), "json").otherwise("text"))


def stream_sql_files(spark: SparkSession, path: str, pattern: str = "*.sql") -> DataFrame:
    """The same rows as a stream: every new file in the folder becomes a row."""
    files = spark.readStream.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_formatted(files: DataFrame, path: str) -> None:
    """Writes (path, output) as a new dataset; sources are never overwritten."""
    ship(files.sparkSession)
    files.select("path", format_column(F.col("text")).alias("f")).select("path", "f.output", "f.error").write.parquet(path)


def changed_files(files: DataFrame) -> DataFrame:
    """(path, diff) of the files that layout changes, and (path, error) of those it can't read."""
    ship(files.sparkSession)
    rows = files.withColumn("f", format_column(F.col("text")))
    rows = rows.filter(F.col("f.error").isNotNull() | (F.col("f.output") != F.col("text")))
    return rows.select("path", unified_diff(F.col("text"), F.col("f.output")).alias("diff"), F.col("f.error").alias("error"))

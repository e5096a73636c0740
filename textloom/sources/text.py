"""Reading texts into (path or key, text) frames, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files above this size are left out by default, as a single text of that size is most likely no document.
MAX_BYTES = 12 * 1024 * 1024


def read_files(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """One row a file: path, text (UTF-8, ill-formed bytes as U+FFFD), is_html by the name; larger files are listed with a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    text = F.when(fits, F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", "length", text.alias("text"), F.lower("path").rlike("\\.html?$").alias("is_html"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line."""
    return spark.read.text(path).select(F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", column: str = "text", **options) -> DataFrame:
    """A table in any format that Spark reads (parquet, orc, json, csv), its text column named ``text``."""
    return spark.read.format(kind).options(**options).load(path).withColumnRenamed(column, "text")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def write_texts(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    """Plain text, one row's text after the other."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)

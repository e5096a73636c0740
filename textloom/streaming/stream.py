"""The same plans on streams: every document operation is stateless, so a streaming frame takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.scan import issues
from textloom.operators.stats import compute_stats
from textloom.plans.cleaner import clean


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def clean_stream(df: DataFrame, options=None, column: str = "text") -> DataFrame:
    return clean(df, options, column)


def scan_stream(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("issues", issues(F.col(column)))


def windowed_stats(df: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", column: str = "text") -> DataFrame:
    """Documents, words and characters by window; rows later than ``late`` are left out by the watermark."""
    s = df.withWatermark(time, late).withColumn("__s", compute_stats(F.col(column)))
    return s.groupBy(F.window(time, window)).agg(
        F.count("*").alias("documents"), F.sum("__s.words").alias("words"), F.sum("__s.characters").alias("characters")
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start(path)

"""Line operations as relations: for questions across documents, and as a second form of the array operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.core import lines, trim


def explode_lines(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, line_no, line), numbered from 0; an empty text has one empty line."""
    return df.select(key, F.posexplode(lines(F.coalesce(F.col(column), F.lit("")))).alias("line_no", "line"))


def implode_lines(rows: DataFrame, key: str) -> DataFrame:
    """The texts back from their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("text"))


def deduplicated(rows: DataFrame, key: str, case_sensitive: bool = False) -> DataFrame:
    """Exploded lines without later repeats in a document; blank lines stay."""
    k = trim(F.col("line")) if case_sensitive else F.lower(trim(F.col("line")))
    first = Window.partitionBy(key, "k").orderBy("line_no")
    return rows.withColumn("k", k).withColumn("n", F.row_number().over(first)).filter("n = 1 or k = ''").drop("k", "n")


def frequent_lines(df: DataFrame, key: str, column: str = "text", min_docs: int = 2) -> DataFrame:
    """(line, n_docs, n_lines) over a corpus; counted per document first, so a hot line costs a row a task."""
    rows = explode_lines(df, key, column).select(key, trim(F.col("line")).alias("line")).filter("line <> ''")
    per_doc = rows.groupBy(key, "line").agg(F.count("*").alias("n"))
    return per_doc.groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).filter(F.col("n_docs") >= min_docs)


def extracted(df: DataFrame, key: str, pattern: str, column: str = "text") -> DataFrame:
    """(key, position, value): matches of a known pattern as rows."""
    from textloom.functions.replace import found

    return df.select(key, F.posexplode(found(F.coalesce(F.col(column), F.lit("")), pattern)).alias("position", "value"))

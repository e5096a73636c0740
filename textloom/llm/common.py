"""Helpers shared by the training-data operators.

Row identity: operators that need to bring results back to a row use the pair ``did`` (``doc_id``, nulls as the smallest
long) and ``thash`` (a hash of the text), so repeated ids with different texts stay apart and fully repeated rows get equal
results. Only named input columns are read, so extra columns cannot clash with working columns.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``doc_id`` null as a join key.
NULL_ID = -(2**63)

#: ASCII white space: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def did(column: str = "doc_id") -> Column:
    """The id as a non-null long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def real_id(column: str = "did") -> Column:
    """The id back from ``did``: null where it was null."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, set here only where it is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textloom-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most keys that ``hot_join`` tells by a broadcast.
HOT = 1000


def hot_join(big: DataFrame, small: DataFrame, on: str | list[str], hot: DataFrame) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has a bounded number of rows a key. The first ``HOT`` keys of ``hot`` go by a broadcast.

    So no task gathers all rows of a frequent key. ``big`` is read twice: let it be a written table.
    """
    keys = [on] if isinstance(on, str) else on
    first = F.broadcast(hot.select(*keys).limit(HOT))
    told = big.join(F.broadcast(small.join(first, keys, "left_semi")), keys)
    return told.unionByName(big.join(first, keys, "left_anti").join(small, keys))


_model: list[tuple] = []


def one_model(key: tuple, make):
    """The large model of a Python worker: there is one, and asking for another lets it go (by its ``close``, if it has one)."""
    if not _model or _model[0][0] != key:
        while _model:
            getattr(_model.pop()[1], "close", int)()
        gc.enable()
        _model.append((key, make()))
    return _model[0][1]


def map_rows(df: DataFrame, schema: str, make, bytes_per_call: int = 16 << 20) -> DataFrame:
    """``make()`` runs once a task and gives ``f(columns: dict of lists) -> dict of lists``, called on slices of Arrow batches.

    A slice holds rows of at most ``bytes_per_call`` bytes together (a longer row is alone), which bounds a worker's memory.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        f = make()
        for batch in batches:
            rows, start = batch.num_rows, 0
            step = rows if batch.nbytes <= bytes_per_call else max(1, int(rows * bytes_per_call / batch.nbytes))
            while start < rows:
                part = batch.slice(start, step)
                start += step
                out = f({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)

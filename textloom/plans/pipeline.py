"""Running operations over a column.

Each operation is a projection of its own, so an operation that mentions its input several times does not multiply the
plan; Catalyst joins the simple ones again. Operations in Python are fenced off from their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import repair
from textloom.functions.core import applied
from textloom.operators.registry import OPS


def run_pipeline(df: DataFrame, enabled: Iterable[str], params: dict[str, dict] | None = None, column: str = "text", errors: str | None = None) -> DataFrame:
    """``df`` with ``column`` changed by the enabled operations in registry order; unknown ids are ignored, null is empty.

    An operation whose parameters are bad is skipped; with ``errors`` that column lists (id, label, message).
    """
    active, failed = set(enabled), []
    out = df.withColumn(column, repair.newlines(F.coalesce(F.col(column), F.lit(""))))
    for op_id, op in OPS.items():
        if op_id not in active:
            continue
        given = {**op.params, **{k: v for k, v in (params or {}).get(op_id, {}).items()}}
        try:
            out = applied(out, column, op.run, **given)
        except ValueError as e:
            failed.append((op_id, op.label, str(e)))
    if errors:
        rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "label", "message"), f, strict=True)]) for f in failed]
        out = out.withColumn(errors, F.array(*rows) if rows else F.array().cast("array<struct<id:string,label:string,message:string>>"))
    return out


def apply_op(df: DataFrame, op_id: str, column: str = "text", **params) -> DataFrame:
    """One operation by itself, with the registry's defaults."""
    return run_pipeline(df, [op_id], {op_id: params}, column)

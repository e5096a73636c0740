"""Mixing sources to target weights by balanced (cube) sampling.

Each source has a target number of words. A document's inclusion is ``target / source size``: its whole part is taken as
full copies, the fraction is an inclusion probability that the cube method turns into 0 or 1. The flight phase moves the
fractions of three documents at a time along the null space of two constraints (words and documents of the source), so
both totals stay put while at least one fraction lands at each move. Blocks of at most about ``BLOCK`` documents of a
source fly alone; what stays fractional flies again with what other blocks left, until one block a source is left. A block
keeps ``RESERVE`` of its documents, evenly spread over its sizes, out of the flight: with the two at most that a flight
leaves they are the landing problem of the last block, whose roundings are all tried. Of those that keep the number of
documents within one, the nearest to the word target is taken. Small and large documents together leave fine steps.

Memory: a task holds one block (ids, sizes, fractions), whatever the share of the largest source. The driver holds one
row a source, the recipe itself. Reruns agree: blocks come from hashes of ids and the random walk is seeded by block.

Defined cases: null texts have size 0; documents of size 0 take 0 words; a null source is a source, last in order; a row
is a document, also where ids repeat; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import did, real_id, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block, about; and blocks whose remainders fly together on the next level.
BLOCK = 8192
FAN = 2048
EPS = 1e-9
#: Documents of a block that wait for the landing.
RESERVE = 14


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words for each source: ``share`` of all sizes dealt by weight; none gets over ``most`` times its size, the excess is dealt again."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            return out
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def recipe(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[tuple]:
    """(source, documents, source_size, target) in code-point order, null last. One row a source comes to the driver."""
    rows = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    found = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    return [(r["source"], r["n"], r["size"], t) for r, t in zip(rows, found, strict=True)]


def _step(x: list[float], v: tuple, at: list[int], rng: random.Random) -> None:
    """One move of the walk from ``x`` along ``v``, to the first wall on a side drawn so that expectations stay."""
    up = min((1 - x[i]) / d if d > 0 else -x[i] / d for i, d in zip(at, v, strict=True) if d)
    down = min(x[i] / d if d > 0 else (x[i] - 1) / d for i, d in zip(at, v, strict=True) if d)
    go = up if rng.random() * (up + down) < down else -down
    for i, d in zip(at, v, strict=True):
        y = x[i] + go * d
        x[i] = 0.0 if y < EPS else 1.0 if y > 1 - EPS else y


def flight(x: list[float], size: list[float], rng: random.Random, waiting: set[int] = frozenset()) -> None:
    """Cube flight in place: sums of ``x`` and of ``size * x`` hold; at most two entries stay fractional beside those ``waiting``."""
    active: list[int] = []
    for i in range(len(x)):
        if EPS <= x[i] <= 1 - EPS and i not in waiting:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            _step(x, v if any(v) else (1.0, -1.0, 0.0), active, rng)
            active = [j for j in active if EPS <= x[j] <= 1 - EPS]
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        _step(x, (1.0, -1.0), active, rng)


def reserve(x: list[float], most: int = RESERVE) -> set[int]:
    """Of the fractional entries, which are in order of size, ``most`` evenly spread ones."""
    loose = [i for i in range(len(x)) if EPS <= x[i] <= 1 - EPS]
    return {loose[k * (len(loose) - 1) // max(most - 1, 1)] for k in range(most)} if len(loose) > most else set(loose)


def landing(x: list[float], size: list[float]) -> None:
    """The last fractions in place: of their roundings that keep their number within one, that whose words come nearest the sum."""
    rest = [i for i in range(len(x)) if EPS <= x[i] <= 1 - EPS]
    words, many = np.zeros(1), np.zeros(1)
    for i in rest:  # rounding m takes document k if bit k of m is set
        words, many = np.concatenate([words, words + size[i]]), np.concatenate([many, many + 1])
    off = np.abs(words - sum(size[i] * x[i] for i in rest))
    off[np.abs(many - sum(x[i] for i in rest)) > 1] += 2 * sum(size) + 1
    best = int(off.argmin())
    for k, i in enumerate(rest):
        x[i] = float(best >> k & 1)


def _fly(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "did"], kind="stable", ignore_index=True)
        name = f"{seed}|{level}|{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}"
        rng = random.Random(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        x, size = pdf["x"].tolist(), pdf["size"].astype(float).tolist()
        flight(x, size, rng, reserve(x))
        if pdf["blocks"].iloc[0] <= 1:
            landing(x, size)
        return pdf.assign(x=x)

    return run


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, tie: Column | None = None) -> DataFrame:
    """(did, tie, source, size, source_size, target, copies): how often each document of ``docs`` is taken.

    ``docs`` needs doc_id, text, source; ``tie`` orders rows of one id (default: a hash of the text).
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(did().alias("did"), (F.xxhash64("text") if tie is None else tie).alias("tie"), "source", n_words(F.col("text")).alias("size")), "sizes"
    )
    found = recipe(sized, weights, share, most)
    rows = [(s, float(t) / z if z else 0.0, z, float(t), max(1, -(-n // BLOCK))) for s, n, z, t in found]
    plan = spark.createDataFrame(rows, "p_source string, p double, source_size long, target double, blocks long")
    given = sized.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    given = given.withColumns(
        {
            "base": F.floor(F.col("p") + EPS),
            "x": F.greatest(F.lit(0.0), F.col("p") - F.floor(F.col("p") + EPS)),
            "block": F.pmod(F.xxhash64("did", "tie", "size"), F.col("blocks")),
        }
    ).drop("p")
    schema = given.schema
    done, blocks, level = [], max((r[4] for r in rows), default=1), 0
    while True:
        flown = written(given.groupBy("source", "block").applyInPandas(_fly(level, seed), schema), f"cube{level}")
        if blocks <= 1:
            done.append(flown)
            break
        landed = (F.col("x") < EPS) | (F.col("x") > 1 - EPS)
        done.append(flown.filter(landed))
        given = flown.filter(~landed).withColumns({"block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN)})
        given = given.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        blocks, level = -(-blocks // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("did", "tie", "source", "size", "source_size", "target", (F.col("base") + F.round("x")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    tie = F.xxhash64("text")
    taken = mix(docs, tie=tie, **options).groupBy("did", "tie").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n"))
    taken = taken.withColumnsRenamed({"did": "__did", "tie": "__tie"})
    # the k-th of n rows alike in id and text gets floor(k c / n) - floor((k - 1) c / n) of their c copies
    alike = Window.partitionBy("__d", "__t").orderBy("__d")
    marked = docs.withColumns({"__d": did(), "__t": tie}).withColumn("__k", F.row_number().over(alike))
    joined = marked.join(taken, (F.col("__d") == F.col("__did")) & (F.col("__t") == F.col("__tie")))
    upto = lambda k: F.floor(k * F.col("__copies") / F.col("__n"))
    times = (upto(F.col("__k")) - upto(F.col("__k") - 1)).cast("int")
    return joined.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    out = mix(docs)
    return out.select(real_id().alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

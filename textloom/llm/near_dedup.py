"""MinHash near-dedup by an LSH forest.

1. Each text becomes the set of its distinct 2-word shingles (64-bit hashes); equal sets are one class from here on, so
   groups of copies cost one row.
2. A class has a MinHash signature of ``VALUES`` values. Each of ``TREES`` trees is the order of all signatures by its own
   drawing of ``DEPTH + EXTRA`` columns: one range-partitioned sort orders all trees, so a crowded stretch spans several
   tasks, whose edges are compared. Classes that share the first ``DEPTH`` columns of a tree are a region.
3. Candidates are neighbours with the longest common prefixes: first the next one in the orders of half the regions.
   Once links among these are confirmed, only classes that are not yet connected are compared, at a depth that follows how crowded their region is: up
   to ``CROWD`` classes, all of the region at once; beyond, first those that share ``DEPTH + EXTRA`` columns, then one column
   less each round, down to the whole region. So nothing is left out, and most of a crowd is connected in small groups.
4. In a group, the rows of its largest component meet the others and the others each other, in cells of ``CELL`` rows a side,
   so neither memory nor time of a task follows the group; the largest component, however large, is never compared with itself.
5. A candidate whose sketches differ too much goes: a sketch has a byte for the least hash in each of ``BINS`` ranges, and
   of the ranges that either set fills, at least the threshold's share must agree, less ``DEVIATIONS`` standard deviations
   (a pair of exactly 0.8 is lost three times in a million). The rest are confirmed on the full sets: those of neighbours by a
   join, as there is one a class and order; those of a group within its cells. There the first pass tells which rows have a
   candidate, the second brings the full sets of these alone, compares all their candidates that links found before have not
   connected, and gives the links that connect more. So no row is ever made for a pair, and the pairs of a crowd cost time alone.
6. Components of confirmed links by alternating large-star and small-star steps on DataFrames.

A pair of similarity 0.8 shares no region with probability 6.5e-5, one of 0.85 with 1e-7 (binomial over agreeing columns).
Texts are shuffled at most once a round, and only those with a candidate left get their sets made again.

Defined cases: null, empty or blank texts have no shingles and stand alone; one word is a shingle of its own; a row is a
document, also where ids repeat or are null: the class of its text is linked, not its id; a null id is taken as the
smallest id and returned as null; a component is named by the least id in it (ties: the least hash of the text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, did, hot_join, map_rows, real_id, written

VALUES = 160
TREES = 64
DEPTH = 7
EXTRA = 4
BINS = 512
DEVIATIONS = 4.5
CROWD = 4096
CELL = 2048
#: So many shingles weigh as much as a row, where a cell holds full sets.
ITEMS = 1024
#: Full sets compared with one at a time, between looks at what is connected.
STEP = 64
FIRST = 2
BROADCAST = 1_000_000
MAX_HASHES = 150_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """The distinct hashes of ``size`` words in a row, A-Z lower-cased; of fewer words, of them all; sorted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    rolled = h[: len(h) - n + 1]
    for k in range(1, n):
        rolled = rolled * BASE + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(rolled + np.uint64(n)))


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(20_24).integers(1 << 62, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(sets, k) 31-bit MinHash values. No set may be empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat, factors = np.concatenate(sets), _multipliers(k)
    out = np.empty((len(sets), k), np.int32)
    for j in range(k):
        out[:, j] = (np.minimum.reduceat(flat * factors[j], starts) >> np.uint64(33)).astype(np.int32)
    return out


_LOW = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)


def sketch_of(items: np.ndarray) -> bytes:
    """Of a sorted set: for each range of hashes a byte of the least one in it, 0 where there is none."""
    at = np.searchsorted(items, _LOW)
    ends = np.append(at[1:], len(items))
    out = np.zeros(BINS, np.uint8)
    full = at < ends
    out[full] = (_mix(items[at[full]]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out.tobytes()


def agreement(rows: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: np.ndarray | int, least: int, deviations: float) -> np.ndarray:
    """Whether sketches, of sets of so many items, leave room for a similarity of ``least`` percent.

    The ranges filled are a draw without replacement from the union, so small sets are judged almost exactly.
    """
    filled = np.maximum(((rows | one) != 0).sum(1), 1)
    same = ((rows == one) & (rows != 0)).sum(1)
    share = least / 100
    union = np.maximum((sizes + size) / (1 + share), 1)
    spread = np.sqrt(share * (1 - share) / filled * np.clip(1 - filled / union, 0.02, 1))
    return same / filled >= share - deviations * spread - 1 / filled


def drawn_columns(values: int, trees: int, depth: int) -> list[np.ndarray]:
    rng = np.random.default_rng(77)
    return [rng.permutation(values)[: depth + EXTRA] for _ in range(trees)]


def keyed(sig: np.ndarray, columns: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each signature and tree the hash of the first ``depth`` columns, and 16 bits of each of the ``EXTRA`` next ones."""
    sig = sig.astype(np.uint64)
    keys, rests = np.empty((len(sig), len(columns)), np.int64), np.empty((len(sig), len(columns)), np.int64)
    for t, drawn in enumerate(columns):
        h = np.full(len(sig), t + 1, np.uint64)
        for c in drawn[:depth]:
            h = _mix(h * BASE + sig[:, c])
        keys[:, t] = h.view(np.int64)
        rest = np.zeros(len(sig), np.uint64)
        for c in drawn[depth:]:
            rest = rest << np.uint64(16) | sig[:, c] >> np.uint64(15)
        rests[:, t] = rest.view(np.int64)
    return keys, rests


def sketched(docs: DataFrame, size: int, values: int, trees: int, depth: int) -> DataFrame:
    """did, thash, n_shingles, s1, s2 (the set's 128-bit identity), marks and tops (the halves of each tree's key), rests, sketch."""

    def make():
        columns = drawn_columns(values, trees, depth)

        def run(c):
            sets = [shingles(t, size) for t in c["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            marks, tops, rests, sketch = ([None] * len(sets) for _ in range(4))
            if full:
                found = keyed(signatures([sets[i] for i in full], values), columns, depth)
                for i, k, r in zip(full, *found, strict=True):
                    halves = k.view(np.uint32).reshape(-1, 2)
                    marks[i], tops[i], rests[i], sketch[i] = halves[:, 0].tobytes(), halves[:, 1].tobytes(), r.tobytes(), sketch_of(sets[i])
            one = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            two = [int(_mix(s ^ BASE).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            own = {"did": c["did"], "thash": c["thash"], "n_shingles": [len(s) for s in sets], "s1": one, "s2": two}
            return own | {"marks": marks, "tops": tops, "rests": rests, "sketch": sketch}

        return run

    given = docs.select(did().alias("did"), F.xxhash64("text").alias("thash"), "text")
    return map_rows(given, "did long, thash long, n_shingles long, s1 long, s2 long, marks binary, tops binary, rests binary, sketch binary", make, 4 << 20)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, items) of the texts named in ``wanted`` (rep, did, thash)."""

    def make():
        return lambda c: {"rep": c["rep"], "items": [shingles(t, size).astype(np.int64) for t in c["text"]]}

    ids = written(wanted, "wanted")
    # up to so many ids go along with the scan (24 MB at most); beyond, the texts are shuffled to them
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    given = docs.select(did().alias("did"), F.xxhash64("text").alias("thash"), "text").join(ids, ["did", "thash"]).select("rep", "text")
    return map_rows(given, "rep long, items array<long>", make, 4 << 20)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def regions(classes: DataFrame) -> DataFrame:
    """(region, rest, rep), a row for each class and tree; ``rest`` is what to sort by."""
    schema = pa.schema([("region", pa.int64()), ("rest", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                low, top, rests = _matrix(part.column(1), np.uint32), _matrix(part.column(2), np.uint32), _matrix(part.column(3), np.int64)
                keys = np.stack([low, top], 2).reshape(len(low), -1).view(np.int64)
                rep = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), rests.ravel(), rep)], schema=schema)

    return classes.select("rep", "marks", "tops", "rests").mapInArrow(run, "region long, rest long, rep long")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of ``regions`` whose region has others, each with the next one of its region.

    (region, rest, rep, next, part, edge); edge 1: the first of its task, 2: the last, 3: both. Those stay in any case, as their region
    may go on in the next task. One shuffle, streamed in order with one row held back.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["region", "rest", "rep", "next", "part", "edge"]
        held, joined, first = None, False, True

        def given(whole, keep, follows, edge):
            n = whole.num_rows
            follows = (follows[0], follows[1] | ((whole.column(0).to_numpy() % FIRST != 0) & (edge == 0)))  # read of these regions alone
            columns = [*whole.columns, pa.array(follows[0], pa.int64(), mask=follows[1]), pa.array(np.full(n, part, np.int32)), pa.array(edge.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            key, rep = whole.column(0).to_numpy(), whole.column(2).to_numpy()
            keep, edge, none = np.zeros(len(key), bool), np.zeros(len(key)), np.ones(len(key), bool)
            same = key[1:] == key[:-1]
            none[:-1] = ~same
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= joined or first
            edge[0] = first and len(key) > 1
            first &= len(key) == 1
            joined = bool(keep[-1])
            keep[-1] = False
            held = whole.slice(whole.num_rows - 1)
            yield given(whole, keep, (np.append(rep[1:], 0), none), edge)
        if held is not None:
            yield given(held, np.ones(1, bool), (np.zeros(1, np.int64), np.ones(1, bool)), np.array([3 if first else 2]))

    key = ("region", "rest", "rep")
    schema = "region long, rest long, rep long, next long, part int, edge int"
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def next_ones(rows: DataFrame) -> DataFrame:
    """(a, b) with a < b: each class and the next one of its region, in the order of a tree, in one of ``FIRST`` regions.

    These connect most of a crowd; more of them would be pairs within one component. What they miss is compared later, in all regions.
    """
    # two rows a task at most
    order = Window.orderBy("part", "edge")
    edges = rows.filter("edge > 0").select("region", "rep", "edge", F.lead("rep").over(order).alias("next"), F.lead("region").over(order).alias("on"))
    across = edges.filter("edge > 1 and on = region").select("rep", "next")  # of any region: they are few
    mine = F.pmod("region", F.lit(FIRST)) == 0
    pairs = rows.filter(mine).select("rep", "next").union(across).filter("rep <> next")
    return pairs.select(F.least("rep", "next").alias("a"), F.greatest("rep", "next").alias("b"))


def cells(known: DataFrame, cell: int) -> DataFrame:
    """``known`` (region, sub, main, n_main, n_other, rep, comp, ...) with (kind, i, j, side), a row for each cell it goes to.

    Kind 0: block i of the main component beside block j of the others; kind 1: blocks i <= j of the others.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / cell).cast("int"), F.lit(1))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mains, others, h = blocks("n_main"), blocks("n_other"), F.xxhash64("rep")
    own = lambda n: F.pmod(h, n).cast("int")
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    main_to = F.transform(upto(others), lambda j: at(0, own(mains), j, F.lit(0)))
    beside = F.transform(upto(mains), lambda i: at(0, i, own(others), F.lit(1)))
    among = F.transform(upto(others), lambda x: at(1, F.least(own(others), x), F.greatest(own(others), x), F.when(own(others) > x, 1).otherwise(0)))
    to = F.when(F.col("comp") == F.col("main"), main_to).otherwise(F.concat(beside, among))
    return known.select("*", F.explode(to).alias("to")).select("*", "to.*").drop("to")


def by_cell(known: DataFrame, cell: int, names: list[str], schema: str, work) -> DataFrame:
    """``work(table of a cell) -> pa.RecordBatch`` for each cell of ``known``; the table has ``names`` beside the cell's own columns, by side and rep."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell_of = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in key], 1)
            cuts = [0, *(np.flatnonzero((cell_of[1:] != cell_of[:-1]).any(1)) + 1).tolist(), len(cell_of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                name = tuple(cell_of[lo].tolist())
                if name != current and held:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                current = name
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    key = ["region", "sub", "kind", "i", "j"]
    spread = cells(known, cell).select(*key, "side", "once", "rep", "comp", *names)
    return spread.repartition(*key).sortWithinPartitions(*key, "side", "rep").mapInArrow(run, schema)


def _column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t.column(name).chunks)


def candidates(t: pa.Table, comp: np.ndarray, least: int, deviations: float):
    """(i, others): a row of a cell and those it meets there that are of other components and whose sketches allow the similarity.

    ``comp`` is read anew for each row. With ``once``, a pair is given in the first tree alone that has it in one region.
    """
    size, side = _column(t, "n_shingles").to_numpy(), _column(t, "side").to_numpy()
    keys, sketch = _matrix(_column(t, "marks"), np.uint32), _matrix(_column(t, "sketch"), np.uint8)
    among, once, region = t["kind"][0].as_py() == 1 and not side.any(), t["once"][0].as_py(), t["region"][0].as_py()
    left = np.flatnonzero(side == 0)
    for i in range(len(size)) if among else np.flatnonzero(side == 1).tolist():
        other = left[left < i] if among else left
        fit = np.minimum(size[other], size[i]) * 100 >= np.maximum(size[other], size[i]) * least
        other = other[fit & (comp[other] != comp[i])]
        if len(other):
            other = other[agreement(sketch[other], size[other], sketch[i], size[i], least, deviations)]
        if len(other) and once:
            first = (keys[other] == keys[i]).argmax(1)
            other = other[keys[i][first] == np.uint32(region & 0xFFFFFFFF)]
        if len(other):
            yield i, other


def hopeful(known: DataFrame, least: int, deviations: float, cell: int) -> DataFrame:
    """The rows (region, sub, once, rep, comp, n_shingles) of ``known`` that have a candidate in their group. A task holds one cell."""

    def work(t):
        good = np.zeros(t.num_rows, bool)
        for i, other in candidates(t, _column(t, "comp").to_numpy(), least, deviations):
            good[i] = good[other] = True
        columns = ["region", "sub", "once", "rep", "comp", "n_shingles"]
        return pa.RecordBatch.from_arrays([_column(t, c).filter(pa.array(good)) for c in columns], columns)

    schema = "region long, sub long, once boolean, rep long, comp long, n_shingles long"
    return by_cell(known, cell, ["n_shingles", "marks", "sketch"], schema, work).distinct()


def connected(known: DataFrame, least: int, deviations: float, cell: int) -> DataFrame:
    """(a, b): links that connect all rows of a cell which its candidates, compared on their full sets (``items``), connect.

    Pairs never leave the task, and a cell gives fewer links than it has rows, however many of its pairs are alike or nearly so.
    """

    def work(t):
        rep, comp, flat = _column(t, "rep").to_numpy(), _column(t, "comp").to_numpy().copy(), _column(t, "items")
        ends, flat = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        items, a, b = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)], [], []
        for i, other in candidates(t, comp, least, deviations):
            while len(other):
                few, other = other[:STEP], other[STEP:]
                sizes, theirs = (ends[few + 1] - ends[few]).astype(np.int64), np.concatenate([items[j] for j in few])
                at = np.minimum(np.searchsorted(items[i], theirs), len(items[i]) - 1)
                shared = np.add.reduceat((items[i][at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
                for j in few[100 * shared >= least * (sizes + len(items[i]) - shared)].tolist():
                    if comp[j] != comp[i]:
                        a.append(rep[i])
                        b.append(rep[j])
                        comp[comp == comp[j]] = comp[i]
                other = other[comp[other] != comp[i]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_cell(known, cell, ["n_shingles", "marks", "sketch", "items"], "a long, b long", work)


def likely(pairs: DataFrame, classes: DataFrame, least: int, deviations: float) -> DataFrame:
    """The (a, b) whose set sizes and sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(i), np.uint8) for i in (2, 3))
                good = agreement(x, batch.column(4).to_numpy(), y, batch.column(5).to_numpy(), least, deviations)
                yield batch.select([0, 1]).filter(pa.array(good))

    slim = classes.select("rep", "n_shingles", "sketch")
    left, right = (slim.select(*[F.col(c).alias(f"{side}_{c}") for c in slim.columns]) for side in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_rep")).join(right, F.col("b") == F.col("b_rep"))
    few, many = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    fit = both.filter(100 * few >= least * many)
    return fit.select("a", "b", "a_sketch", "b_sketch", "a_n_shingles", "b_n_shingles").mapInArrow(run, "a long, b long")


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, items) of the classes in ``wanted`` (rep)."""
    named = classes.select("rep", "did", "thash").join(wanted, "rep", "left_semi")
    # rows that repeat fully have equal sets
    return written(sets_of(docs, named, size), "sets").groupBy("rep").agg(F.max("items").alias("items"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, least: int) -> DataFrame:
    """The (a, b) among ``pairs`` with 100 * intersection >= ``least`` * union on the full sets."""
    sets = full_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))), classes, docs, size)
    left, right = (sets.select(*[F.col(c).alias(f"{side}_{c}") for c in sets.columns]) for side in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_rep")).join(right, F.col("b") == F.col("b_rep"))
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return both.filter(100 * shared >= least * (F.size("a_items") + F.size("b_items") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(rep, comp) for each end of a link: the least id reachable. Alternating stars, written to the shared folder each round."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        large = hot_join(both, least.drop("n"), "u", least.orderBy(F.desc("n"), "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = hot_join(large, low.drop("n"), "u", low.orderBy(F.desc("n"), "u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = written(small.filter("u <> v").distinct(), "small")
        # stars: each end has one edge and no centre is an end
        ends = small.groupBy("u").agg(F.count("*").alias("n"))
        loose = ends.filter("n > 1").select("u").union(small.join(ends.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if not loose.limit(1).count():
            break
        edges = small
    return small.select(F.col("u").alias("rep"), F.col("v").alias("comp"))


def classes_of(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names: s1, s2, n, did, thash, rep; classes: rep, did, thash, n_shingles, marks, tops, rests, sketch).

    A class is named by its least row; ``rep`` is that row's id, or a hash of the class where the id is null or names several classes.
    """
    full = base.filter("n_shingles > 0")
    first = full.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("did", "thash")).alias("lead")).select("s1", "s2", "n", "lead.*")
    first = written(first, "first")
    again = first.filter(F.col("did") != NULL_ID).groupBy("did").agg(F.count("*").alias("names")).filter("names > 1")
    named = first.filter(F.col("did") != NULL_ID).join(again, "did", "left").unionByName(first.filter(F.col("did") == NULL_ID).withColumn("names", F.lit(2).cast("long")))
    rep = F.when(F.col("names").isNull(), F.col("did")).otherwise(F.xxhash64("s1", "s2", "did"))
    names = written(named.select("s1", "s2", "n", "did", "thash", rep.alias("rep")), "names")
    rows = full.select("did", "thash", "n_shingles", "marks", "tops", "rests", "sketch").join(names.select("did", "thash", "rep"), ["did", "thash"])
    # rows that repeat fully are one; they lie together already, by id and hash of the text
    same = F.max(F.struct("n_shingles", "marks", "tops", "rests", "sketch")).alias("x")
    return names, written(rows.groupBy("did", "thash", "rep").agg(same).select("rep", "did", "thash", "x.*"), "classes")


def sized(inside: DataFrame, weight: F.Column) -> DataFrame:
    """``inside`` (region, sub, rep, comp, ...), a written table, with main, n_main, n_other: the largest component of a group, the weight
    of its rows and that of the others. Groups of one component go."""
    parts = inside.groupBy("region", "sub", "comp").agg(F.sum(weight).alias("n"))
    groups = parts.groupBy("region", "sub").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    groups = groups.select("region", "sub", "n", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"), (F.col("n") - F.col("top.n")).alias("n_other"))
    groups = written(groups.filter("n_other > 0"), "groups")
    return hot_join(inside, groups.drop("n"), ["region", "sub"], groups.orderBy(F.desc("n"), "region", "sub"))


def open_groups(rows: DataFrame, comps: DataFrame, extra: int, crowd: int, first: bool) -> DataFrame:
    """The rows (region, sub, rep, comp, main, n_main, n_other, once) of groups that hold two components or more.

    Groups are regions of at most ``crowd`` rows (the ``first`` time only), and of larger ones the rows that share ``extra`` columns more.
    """
    comp = F.coalesce("comp", "rep").alias("comp")
    marked = written(rows.select("region", "rest", "rep").join(comps, "rep", "left").select("region", "rest", "rep", comp), "marked")
    sizes = marked.groupBy("region").agg(F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    sizes = written(sizes.filter("c1 <> c2").select("region", "n").filter(F.lit(True) if first else F.col("n") > crowd), "sizes")
    sub = F.shiftrightunsigned("rest", 16 * (EXTRA - extra)) if extra else F.lit(0).cast("long")
    crowded = F.col("n") > crowd
    inside = hot_join(marked, sizes, "region", sizes.orderBy(F.desc("n"), "region"))
    inside = inside.select("region", F.when(crowded, sub).otherwise(0).alias("sub"), "rep", "comp", (~crowded if extra else F.lit(True)).alias("once"))
    inside = written(inside, "inside")
    return sized(inside, F.lit(1))


def grouped(
    docs: DataFrame,
    size: int = 2,
    least: int = 80,
    values: int = VALUES,
    trees: int = TREES,
    depth: int = DEPTH,
    crowd: int = CROWD,
    cell: int = CELL,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """did, thash, n_shingles, component (did of the least document reachable), lead (its thash), a row for each row of ``docs``."""
    base = written(sketched(docs, size, values, trees, depth), "sketches")
    names, classes = classes_of(base)
    rows = written(in_order(regions(classes)), "regions")
    pairs = written(next_ones(rows).distinct(), "near")
    links = written(confirmed(written(likely(pairs, classes, least, deviations), "likely"), classes, docs, size, least), "links")
    comps = components(links)
    crowds = rows.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).limit(1).count()
    for extra in range(EXTRA if crowds else 0, -1, -1):
        open_ = written(open_groups(rows, comps, extra, crowd, extra == EXTRA or not crowds), "open")
        if not open_.limit(1).count():
            continue
        sketches = classes.select("rep", "n_shingles", "marks", "sketch")
        some = written(hopeful(open_.join(sketches, "rep"), least, deviations, cell), "hopeful")
        # a cell is bounded in rows and in shingles
        again = sized(some, 1 + F.floor(F.col("n_shingles") / ITEMS)).drop("n_shingles")
        sets = sketches.join(full_sets(some.select("rep"), classes, docs, size), "rep")
        more = written(connected(again.join(sets, "rep"), least, deviations, cell), "links")
        links = links.union(more)
        comps = components(links)
    comps = comps.union(comps.select(F.col("comp").alias("rep"), "comp").distinct())  # the least end of a component too
    linked = written(names.join(comps, "rep"), "linked")
    leads = written(linked.groupBy("comp").agg(F.count("*").alias("many"), F.min(F.struct("did", "thash")).alias("lead")), "leads")
    joined = hot_join(linked.select("s1", "s2", "n", "comp"), leads.select("comp", "lead"), "comp", leads.orderBy(F.desc("many"), "comp"))
    alone = names.join(comps, "rep", "left_anti").select("s1", "s2", "n", F.struct("did", "thash").alias("lead"))
    named = written(joined.select("s1", "s2", "n", "lead").unionByName(alone), "named")
    own = base.select("did", "thash", "n_shingles", "s1", "s2")
    found = hot_join(own.filter("n_shingles > 0"), named.drop("n"), ["s1", "s2"], named.orderBy(F.desc("n"), "s1", "s2"))
    found = found.select("did", "thash", "n_shingles", F.col("lead.did").alias("component"), F.col("lead.thash").alias("lead"))
    return found.union(own.filter("n_shingles = 0").select("did", "thash", "n_shingles", F.col("did").alias("component"), F.col("thash").alias("lead")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id, kept."""
    out = grouped(docs)
    return out.select(real_id().alias("doc_id"), "n_shingles", real_id("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, all columns, of each group: the one with the least id (ties: least hash of the text; of rows that repeat fully, any)."""
    out = written(grouped(docs, **options).withColumnsRenamed({"did": "__did", "thash": "__thash"}), "grouped")
    least = (F.col("__did") == F.col("component")) & (F.col("__thash") == F.col("lead"))
    here = docs.withColumns({"__d": did(), "__t": F.xxhash64("text")})
    at = (F.col("__d") == F.col("__did")) & (F.col("__t") == F.col("__thash"))
    kept = here.join(out.filter(~least).select("__did", "__thash").distinct(), at, "left_anti")
    again = written(out.filter(least & (F.col("n_shingles") > 0)).groupBy("__did", "__thash").count().filter("count > 1").drop("count"), "again")
    if again.limit(1).count():
        kept = kept.join(again, at, "left_anti").union(kept.join(again, at, "left_semi").dropDuplicates(["__d", "__t"]))
    return kept.select(*docs.columns)

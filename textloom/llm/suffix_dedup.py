"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Sorting a suffix for each byte would need hundreds of bytes of key for each byte of text, so the suffix array is sparse:

1. Of the windows of ``SHORT`` bytes, each picks the least hash among its ``GRAM``-byte grams (leftmost on ties). Equal
   windows pick at equal offsets, so comparing the suffixes that start at picked places loses no repeat, of ``SHORT`` bytes or
   more. A pick serves a run of neighbouring windows. Runs with equal bytes all through count as one row from here on, with
   the number of their places, so hot passages, copies and periodic texts cost few rows. Picks whose gram is found once in
   the corpus go.
2. The picked suffixes, each with the bytes to its left, are range-partitioned by their leading ``KEY`` bytes (then by the
   bytes to the left), with splitters that Spark samples. A task sorts its range in chunks of at most ``CHUNK`` suffixes by
   multikey quicksort on 8-byte tokens, to full depth: suffixes in order, and the left sides in order.
3. The common prefixes of sorted neighbours decide: a window that begins ``off`` bytes left of a pick is repeated if another
   suffix shares ``LENGTH - off`` bytes to the right and ``off`` bytes to the left, that is if the two lie in one stretch of
   neighbours with so much in common in both orders. Bytes are compared, not hashes.
4. Stretches that reach a chunk's first or last suffix are compared across boundaries: each gives one row for each window
   (gram, offset and hash of the window, number of places), and an aggregate brings those of all chunks together. Whatever
   the size of a stretch, a chunk gives each of its windows once.
5. Repeated windows return to their documents, where overlapping ones merge and their bytes go.

Runs count as equal, and windows of different chunks too, if the gram's 64-bit hash and 64 bits of another agree. Joins on grams and
runs send the ``HOT`` most frequent ones by a broadcast of bounded size, so no task gathers a hot one. Texts are shuffled
twice, packed by zstd, and long texts are hashed in segments, so a task holds little more than its rows.

The same order decides a second, shorter length: ``n_passage`` of ``digest`` tells the bytes covered by strings of ``SHORT``
bytes that start elsewhere too (50 words and more are often under ``LENGTH`` bytes); they are told, not removed.

Defined cases: null texts have no bytes; texts under ``LENGTH`` bytes lose nothing; a row is a document, so a fully repeated
row repeats every window; removal may cut through a UTF-8 character: ``kept`` is bytes, and as text ill-formed parts go.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import did, map_rows, real_id, written

LENGTH = 400
SHORT = 300
GRAM = 64
KEY = 160
CHUNK = 16_384
BUCKET = 20_000
#: Grams and runs told by a broadcast, at most.
HOT = 1000
SEGMENT = 1 << 18  # windows hashed at once
_BITS = 20  # of a place within a segment
_B = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << _BITS) - 1)
_OFF = 10  # bits of an offset in a spot


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    n, inverse = SEGMENT + 2 * LENGTH, pow(_B, -1, 1 << 64)
    out = []
    for base in (_B, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _powers()
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _between(prefix: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``at`` to ``to``, whatever their place."""
    return _mix((prefix[to] - prefix[at]) * _powers()[1][at])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def picks(text: bytes) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, gram hash, hash of all bytes of the run up to ``LENGTH`` after its last window) of each run."""
    parts: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    windows = len(data) - SHORT + 1
    for start in range(0, windows, SEGMENT):
        n = min(SEGMENT, windows - start)
        piece = data[start : start + n - 1 + LENGTH]
        prefix = _prefix(piece)
        at = np.arange(n + SHORT - GRAM)
        hashes = _between(prefix, at, at + GRAM)
        least = window_minima((hashes & ~_PLACE) | at.astype(np.uint64), SHORT - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        place = (least[first] & _PLACE).astype(np.int64)
        end = np.minimum(last + LENGTH, len(piece))
        shape = ((place - first) << 20) + ((last - first) << 10) + (end - last)
        whole = _between(prefix, first, end) ^ _mix(shape.astype(np.uint64))
        parts.append((place + start, first + start, last + start, hashes[place].view(np.int64), whole.view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def distinct_picks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, run, spot) of a text: its runs, equal ones once; and the stretches of windows of those that the text repeats.

    A spot holds the place, its distance to the first and last window, and whether the text holds the run again. A stretch has
    its first and last window for gram and run, and spot -1.
    """
    place, first, last, gram, whole = picks(text)
    spot = (place << (2 * _OFF + 1)) | ((place - first) << (_OFF + 1)) | ((place - last) << 1)
    order = np.lexsort((place, whole, gram))
    g, w = gram[order], whole[order]
    same = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
    if not same.any():
        return gram, whole, spot
    again = np.zeros(len(g), bool)
    again[order[1:][same]] = True
    doubled = again.copy()
    doubled[order[:-1][same]] = True
    at = np.flatnonzero(doubled)
    new = np.concatenate([[True], first[at[1:]] != last[at[:-1]] + 1])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(at)]]) - 1
    keep = ~again
    joined = lambda own, more: np.concatenate([own[keep], more])
    return joined(gram, first[at[starts]]), joined(whole, last[at[ends]]), joined(spot | doubled, np.full(len(starts), -1))


def tokens(pieces: list[bytes], width: int) -> np.ndarray:
    """Rows of 8-byte tokens in byte order, filled up with zeros."""
    width += -width % 8
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), ">u8").reshape(len(pieces), width // 8).astype(np.uint64)


def multikey_quicksort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of token rows, and the bytes that each has in common with the one before it.

    All open segments are partitioned by the token at one depth at once; rows with equal tokens are a segment and go one token deeper.
    """
    n, depth = rows.shape
    order, common = np.arange(n), np.full(n, 8 * depth, np.int64)
    if n:
        common[0] = 0
    at, segment = np.arange(n), np.zeros(n, np.int64)  # places of the order in segments of two or more
    for d in range(depth):
        if len(at) < 2:
            break
        token = rows[order[at], d]
        by = np.lexsort((token, segment))
        order[at], token = order[at][by], token[by]
        inside = segment[1:] == segment[:-1]
        split = inside & (token[1:] != token[:-1])
        x = token[1:][split] ^ token[:-1][split]
        common[at[1:][split]] = 8 * d + sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
        new = np.concatenate([[True], ~inside | split])
        segment = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])
        at, segment = at[~alone], segment[~alone]
    return order, common


class Chunk:
    """Suffixes (bytes to the right of a pick, bytes to its left read backwards) with their windows' offsets and places' number.

    ``found``: by length, whether the window at (suffix, offset) is repeated. ``open``: (length, suffix, offset, places) of one
    window of each class that may go on beyond the chunk.
    """

    def __init__(self, right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, copies: np.ndarray, lengths: tuple[int, ...]):
        n, offsets = len(right), int(high.max()) + 1
        by, common = multikey_quicksort(tokens(right, max(map(len, right))))
        # all that follows is in the order of the suffixes
        self.order = by
        low, high, copies, size = low[by], high[by], copies[by], np.array([len(x) for x in right])[by]
        left_by, left_common = multikey_quicksort(tokens([left[i] for i in by], max(map(len, left))))
        from_first = np.minimum.accumulate(np.concatenate([[KEY], common[1:]]))
        from_last = np.minimum.accumulate(np.concatenate([common[1:], [KEY]])[::-1])[::-1]
        edge = np.minimum(np.maximum(from_first, from_last), KEY)
        self.found = {length: np.zeros((n, offsets), bool) for length in lengths}
        parts: list[tuple[np.ndarray, ...]] = []
        left_class = np.empty(n, np.int64)
        for off in range(offsets):
            left_class[left_by] = np.cumsum(left_common < off)
            here = (low <= off) & (off <= high)
            for length in lengths:
                depth = length - off
                at = np.flatnonzero(here & (size >= depth))
                if not len(at):
                    continue
                key = np.cumsum(common < depth)[at] * n + left_class[at]
                order = np.argsort(key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                total = np.add.reduceat(copies[at][order], starts)
                many = np.repeat(total > 1, np.diff(np.append(starts, len(at))))
                self.found[length][at[order[many]], off] = True
                one = at[order[starts]]
                reach = edge[one] >= min(depth, KEY)
                if reach.any():
                    parts.append((np.full(reach.sum(), length), one[reach], np.full(reach.sum(), off), np.minimum(total[reach], 2)))
        self.open = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))

    def stretches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, least offset, greatest offset) of each stretch of repeated windows."""
        n = len(self.order)
        wall = np.zeros((n, 1), np.int8)
        edges = np.diff(np.hstack([wall, self.found[length].view(np.int8), wall]), axis=1)
        who, a = np.nonzero(edges == 1)
        _, b = np.nonzero(edges == -1)
        return self.order[who], a, b - 1


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _packed(docs: DataFrame) -> DataFrame:
    """did, thash, packed: the text's UTF-8 bytes under zstd."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return lambda c: {"did": c["did"], "thash": c["thash"], "packed": [pack((t or "").encode()) for t in c["text"]]}

    given = docs.select(did().alias("did"), F.xxhash64("text").alias("thash"), "text")
    return map_rows(given, "did long, thash long, packed binary", make, 8 << 20)


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def picked(docs: DataFrame) -> DataFrame:
    """did, thash, gram, run, spot: the ``distinct_picks`` of each text."""
    schema = pa.schema([(name, pa.int64()) for name in ("did", "thash", "gram", "run", "spot")])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, hashes, found = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i, text in enumerate(part.column(2)):
                    x = distinct_picks((text.as_py() or "").encode())
                    if len(x[0]):
                        found.append((np.full(len(x[0]), ids[i]), np.full(len(x[0]), hashes[i]), *x))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    given = docs.select(did().alias("did"), F.xxhash64("text").alias("thash"), "text")
    return given.mapInArrow(run, "did long, thash long, gram long, run long, spot long")


def _place() -> F.Column:
    return F.shiftright("spot", 2 * _OFF + 1)


def _off(bit: int) -> F.Column:
    return F.shiftright("spot", bit).bitwiseAND(F.lit((1 << _OFF) - 1))


def crowded(all_runs: DataFrame) -> DataFrame:
    """The runs whose gram has two places or more."""
    places = F.sum(1 + F.col("spot").bitwiseAND(F.lit(1)))
    crowd = written(all_runs.groupBy("gram").agg(places.alias("n")).filter("n > 1"), "grams")
    hot = F.broadcast(crowd.orderBy(F.desc("n"), "gram").limit(HOT).select("gram"))
    return all_runs.join(hot, "gram", "left_semi").union(all_runs.join(hot, "gram", "left_anti").join(crowd, "gram", "left_semi"))


def _suffixes(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(gram, run, low, high, copies, right, left): a suffix for each kind, out of one text that holds it."""

    def make():
        def run(c):
            out: dict[str, list] = {"gram": [], "run": [], "low": [], "high": [], "copies": [], "right": [], "left": []}
            for packed, runs in zip(c["packed"], c["runs"], strict=True):
                text = _unpack(packed)
                for r in runs:
                    place = r["place"]
                    for name in ("gram", "run", "low", "high", "copies"):
                        out[name].append(r[name])
                    out["right"].append(text[place : place - r["low"] + LENGTH])
                    out["left"].append(text[place - r["high"] : place][::-1])
            return out

        return run

    runs = kinds.groupBy("did", "thash").agg(F.collect_list(F.struct("gram", "run", "copies", "place", "low", "high")).alias("runs"))
    joined = _packed(docs).join(runs, ["did", "thash"]).select("packed", "runs")
    return map_rows(joined, "gram long, run long, low int, high int, copies long, right binary, left binary", make, 4 << 20)


def _sorted_repeats(suffixes: DataFrame, n: int, lengths: tuple[int, ...]) -> DataFrame:
    """(length, gram, run, low, high, hash, places): repeated windows, by stretches of offsets; with a hash: one that may go on elsewhere."""
    types = {"length": pa.int32(), "gram": pa.int64(), "run": pa.int64(), "low": pa.int32(), "high": pa.int32(), "hash": pa.int64(), "places": pa.int64()}

    def rows(length, gram, run, low, high, hash_=None, places=None):
        nothing = pa.nulls(len(gram), pa.int64())
        columns = [length, gram, run, low, high, nothing if hash_ is None else hash_, nothing if places is None else places]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    def decide(table: pa.Table):
        right, left = (table.column(c).to_pylist() for c in ("right", "left"))
        gram, run, low, high, copies = (table.column(c).to_numpy() for c in ("gram", "run", "low", "high", "copies"))
        chunk = Chunk(right, left, low, high, copies, lengths)
        for length in lengths:
            who, a, b = chunk.stretches(length)
            yield rows(np.full(len(who), length), gram[who], run[who], a, b)
        length, at, off, places = chunk.open
        who = chunk.order[at]
        hashes = np.empty(len(who), np.int64)
        by = np.argsort(who, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(who[by])) + 1) if len(by) else ():
            i = who[own[0]]
            first = len(left[i]) - off[own]
            hashes[own] = _between(_prefix(np.frombuffer(left[i][::-1] + right[i], np.uint8)), first, first + length[own]).view(np.int64)
        yield rows(length, gram[who], run[who], off, off, hashes, places)

    def sort(batches):
        held, many = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - many)
                batch = batch.slice(part.num_rows)
                held.append(part)
                many += part.num_rows
                if many == CHUNK:
                    yield from decide(pa.Table.from_batches(held))
                    held, many = [], 0
        if many:
            yield from decide(pa.Table.from_batches(held))

    parts = min(100_000, max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET)))
    key = [F.substring("right", 1, KEY), F.substring("left", 1, 16), F.col("run")]
    ranged = suffixes.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return ranged.mapInArrow(sort, "length int, gram long, run long, low int, high int, hash long, places long")


def repeated_windows(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH, SHORT)) -> DataFrame:
    """(did, thash, length, w1, w2): windows of ``docs`` texts that start elsewhere too, as first and last starts of stretches.

    Length null: windows of all ``lengths``, as far as the text has them.
    """
    found_runs = written(picked(docs), "picks")
    runs = written(crowded(found_runs.filter("spot >= 0")), "runs")
    spot = F.struct("did", "thash", _place().alias("place"), _off(1).cast("int").alias("low"), _off(_OFF + 1).cast("int").alias("high"))
    kinds = runs.groupBy("gram", "run").agg(F.sum(1 + F.col("spot").bitwiseAND(F.lit(1))).alias("copies"), F.min(spot).alias("at"))
    kinds = written(kinds.select("gram", "run", "copies", "at.*"), "kinds")
    decided = written(_sorted_repeats(_suffixes(docs, kinds), kinds.count(), lengths), "decided")
    # across boundaries: a class with one place in its chunk is repeated if another chunk has it
    lone = F.collect_list(F.when(F.col("places") == 1, F.col("run")))
    met = decided.filter("hash is not null").groupBy("length", "gram", "low", "hash").agg(F.sum("places").alias("n"), lone.alias("runs")).filter("n > 1")
    met = met.select("length", "gram", F.explode("runs").alias("run"), "low", F.col("low").alias("high"))
    inside = decided.filter("hash is null").select("length", "gram", "run", "low", "high")
    found = written(inside.union(met).groupBy("gram", "run").agg(F.collect_set(F.struct("length", "low", "high")).alias("windows")), "found")
    hot = F.broadcast(kinds.orderBy(F.desc("copies"), "gram", "run").limit(HOT).select("gram", "run"))
    hot_found = F.broadcast(found.join(hot, ["gram", "run"], "left_semi"))
    told = runs.join(hot_found, ["gram", "run"])
    met = runs.join(hot, ["gram", "run"], "left_anti").join(found, ["gram", "run"])
    pieces = told.union(met).select("did", "thash", _place().alias("place"), F.explode("windows").alias("w"))
    pieces = pieces.select("did", "thash", "w.length", (F.col("place") - F.col("w.high")).alias("w1"), (F.col("place") - F.col("w.low")).alias("w2"))
    own = found_runs.filter("spot < 0").select("did", "thash", F.lit(None).cast("int").alias("length"), F.col("gram").alias("w1"), F.col("run").alias("w2"))
    return pieces.union(own)


def merged(stretches: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes (start, end) of windows that start from first to last."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _covered(windows: list, length: int, size: int) -> list[tuple[int, int]]:
    """The runs of bytes that the repeated windows of ``length`` cover in a text of ``size`` bytes."""
    own = [(w["w1"], min(w["w2"], size - length)) for w in windows if w["length"] in (None, length) and w["w1"] <= size - length]
    return merged(own, length)


def deduplicated(docs: DataFrame, schema: str, row, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """``row(id, text bytes, runs covered by repeats of each length) -> dict`` for each document."""
    per_doc = repeated_windows(docs, lengths).groupBy("did", "thash").agg(F.collect_set(F.struct("length", "w1", "w2")).alias("windows"))

    def make():
        def run(c):
            out: list[dict] = []
            for i, packed, windows in zip(c["did"], c["packed"], c["windows"], strict=True):
                text = _unpack(packed)
                out.append(row(i, text, *[_covered(windows or [], n, len(text)) for n in lengths]))
            return {k: [o[k] for o in out] for k in out[0]} if out else {f.split()[0]: [] for f in schema.split(", ")}

        return run

    joined = _packed(docs).join(per_doc, ["did", "thash"], "left").select("did", "packed", "windows")
    return map_rows(joined, schema, make, 4 << 20)


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _digest_row(i: int, text: bytes, removed: list[tuple[int, int]], passages: list[tuple[int, int]]) -> dict:
    kept = kept_bytes(text, removed)
    counts = {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(removed), "n_passage": sum(b - a for a, b in passages)}
    return {"did": i, **counts, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _text_row(i: int, text: bytes, removed: list[tuple[int, int]]) -> dict:
    return {"did": i, "text": kept_bytes(text, removed).decode("utf-8", "ignore"), "starts": [a for a, _ in removed], "ends": [b for _, b in removed]}


def cleaned(docs: DataFrame) -> DataFrame:
    """did, text without repeats, starts and ends of the removed bytes."""
    return deduplicated(docs, "did long, text string, starts array<long>, ends array<long>", _text_row)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and n_passage."""
    out = deduplicated(docs, "did long, n_bytes long, n_removed long, n_spans long, n_passage long, kept_sha256 string", _digest_row, (LENGTH, SHORT))
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")

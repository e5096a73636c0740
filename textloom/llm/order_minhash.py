"""Document fingerprints by Order MinHash, with DataFrame functions only.

Tokens are runs of at most ``PIECE`` characters other than ASCII white space; a k-mer is ``K`` tokens in a row (all of
them in a shorter text). K-mers that repeat in a text are numbered by occurrence. Each of ``ENTRIES`` hash functions orders
the numbered k-mers; its two least, in the order they have in the text, are hashed to an entry of the fingerprint (the only
one, if there is one). Equal entries need the same two k-mers, occurrences and order, so their share falls with edits and
with moved blocks alike; its standard error is at most 0.5 / sqrt(``ENTRIES``).

The next document by id comes from a window over buckets of neighbouring rows: sampled splitters cut them, and the first
row after a bucket visits it as a guest, so the texts are shuffled once. Of the splitters there are ``MOST`` at most (16
bytes each), which go along with the plan. Tokens are exploded inside their bucket: numbering and minima need no further
shuffle. The two least come from sums of minima alone: one for each digit of a place, and no array of them grows with a text.
Places are told apart exactly below 2^19 k-mers, and beyond to one part in 2^19 of themselves (ties: by hash).

Defined cases: null texts are empty; an empty text has the fingerprint of no tokens, equal to any other such and unlike all
others; rows of one id are ordered by a hash of the text, fully repeated
rows are each other's next; null ids come first; a single document is its own next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import did, real_id, written

K = 2
ENTRIES = 16
PIECE = 4
TOKEN = r"[^\x20\x09-\x0D]{1,%d}" % PIECE
#: Places are grouped by their digits in this base, and digits by quotient and remainder of ``PART``.
BASE = 32
PART = 6
#: Rows of a bucket, about, and most buckets.
ROWS = 1000
MOST = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def rolled(tokens_: Column, k: int) -> Column:
    """Hashes of k neighbours."""
    n = F.greatest(F.size(tokens_) - (k - 1), F.lit(0))
    out = F.slice(tokens_, 1, n)
    for i in range(1, k):
        out = F.zip_with(out, F.slice(tokens_, i + 1, n), lambda a, b: F.xxhash64(a, b))
    return out


def kmers(tokens_: Column, k: int) -> Column:
    """Hashes of k tokens in a row; of fewer, of all; none of none."""
    short = F.when(F.size(tokens_) > 0, F.array(F.xxhash64(tokens_))).otherwise(F.array().cast("array<long>"))
    return F.when(F.size(tokens_) >= k, rolled(tokens_, k)).otherwise(short)


def _coded(place: Column) -> Column:
    """A place in 23 bits, in order: exact below 2^19, then with 19 bits after the leading one."""
    e = F.greatest(F.floor(F.log2(F.greatest(place, F.lit(1)))) - 19, F.lit(0)).cast("int")
    shift = lambda way, x, by: F.call_function(f"shift{way}", x, by)
    far = shift("left", (e + 1).cast("long"), F.lit(19)) + shift("right", place - shift("left", F.lit(1).cast("long"), e + 19), e)
    return F.when(place < 1 << 19, place).otherwise(far)


def _value(j: int) -> Column:
    """Of hash function j: 40 bits of hash above the place."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(j), F.col("unit")), 24), 23).bitwiseOR(F.col("place"))


def _digits(n: Column) -> Column:
    """Digits in base ``BASE`` of places below n."""
    out = F.when(n <= BASE, 1)
    for k in range(2, 7):
        out = out.when(n <= BASE**k, k)
    return out.otherwise(7)


def _entry(values: Column) -> Column:
    """The two least of some values (there may be one or none), in text order, hashed."""
    first = F.array_min(values)
    second = F.array_min(F.array_remove(values, first))
    two = F.filter(F.array(first, second), lambda v: v.isNotNull())
    placed = F.transform(two, lambda v: F.struct(v.bitwiseAND(F.lit((1 << 23) - 1)).alias("place"), F.shiftright(v, 23).alias("hash")))
    return F.xxhash64(F.transform(F.sort_array(placed), lambda x: x["hash"]))


def fingerprints(pairs: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """(bucket, row, entries, edited_entries) for each (bucket, row, head, text, edited); row names a row of its bucket.

    Both versions begin with ``head``, which is empty or ends in white space; ``text`` and ``edited`` are what follows (null:
    no such version). K-mers of the head stand once for both, so the work is that of the differing text. Where the input is
    partitioned by bucket, nothing is shuffled.
    """
    rows = pairs.select("bucket", "row", *[hashes(F.coalesce(c, F.lit(""))).alias(c) for c in ("head", "text", "edited")], F.col("edited").isNotNull().alias("two"))
    last = F.slice("head", F.greatest(F.size("head") - (k - 2), F.lit(1)), k - 1) if k > 1 else F.array().cast("array<long>")

    def own(version: str) -> Column:
        """The k-mers of a version that are not inside the head."""
        few = F.size("head") + F.size(version) < k
        return F.when(few, kmers(F.concat("head", version), k)).otherwise(rolled(F.concat(last, version), k))

    nothing = F.array().cast("array<long>")
    rows = rows.select("bucket", "row", rolled(F.col("head"), k).alias("s"), own("text").alias("x"), F.when(F.col("two"), own("edited")).otherwise(nothing).alias("y"))
    rows = rows.select("bucket", "row", F.size("s").alias("ns"), F.size("x").alias("nx"), F.size("y").alias("ny"), F.posexplode_outer(F.concat("s", "x", "y")).alias("at", "kmer"))
    side = F.when(F.col("at") < F.col("ns"), 0).when(F.col("at") < F.col("ns") + F.col("nx"), 1).otherwise(2)
    pos = F.when(side == 2, F.col("at") - F.col("nx")).otherwise(F.col("at")).cast("long")
    # sorting starts with a hash of row and k-mer, under 6 bits of the row: one comparison of longs settles nearly all of it, and
    # what follows meets a few rows at a time, whose minima stay in the processor's cache
    near = F.shiftleft(F.pmod(F.shiftright("row", 4), F.lit(64)).cast("long"), 58)
    rows = rows.select("bucket", "row", "kmer", side.alias("side"), pos.alias("place"), _digits(F.col("ns") + F.greatest("nx", F.col("ny"))).alias("digits"), near.bitwiseOR(F.shiftrightunsigned(F.xxhash64("row", "kmer"), 6)).alias("own"))
    seen = Window.partitionBy("own", "bucket").orderBy("side", "place")
    sofar = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # occurrences count within a version: for the edited one, those of the other's own part do not
    others = F.when(F.col("side") == 2, F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(sofar)).otherwise(0)
    numbered = rows.withColumn("unit", F.xxhash64("kmer", (F.row_number().over(seen) - others).cast("int")))
    # the least of each group of places with one digit in common, digit by digit: two places differ in some digit, so the
    # second least of all is the least of a group that the least is not in; the groups' digits are parted likewise
    names = [f"v{j}" for j in range(entries)]
    by_digit = numbered.select("bucket", "row", "side", "kmer", "unit", "place", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("digit"))
    own = F.call_function("shiftright", F.col("place"), F.col("digit") * (BASE.bit_length() - 1)).bitwiseAND(F.lit(BASE - 1)).alias("own")
    by_digit = by_digit.select("bucket", "row", "side", "kmer", "unit", _coded(F.col("place")).alias("place"), "digit", own)
    least = by_digit.groupBy("bucket", "row", "side", "digit", "own").agg(*[F.min(F.when(F.col("kmer").isNotNull(), _value(j))).alias(n) for j, n in enumerate(names)])
    least = least.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    part = F.when(F.col("half") == 0, F.floor(F.col("own") / PART)).otherwise(F.col("own") % PART).alias("part")
    of = lambda sides: [F.min(F.when(F.col("side").isin(*sides), F.col(n))).alias(f"{n}_{sides[1]}") for n in names]
    both = least.groupBy("bucket", "row", "digit", "half", part).agg(*of((0, 1)), *of((0, 2)))
    found = both.groupBy("bucket", "row").agg(F.collect_list(F.array(*[F.col(f"{n}_{k}") for k in (1, 2) for n in names])).alias("all"))

    def of_version(first: int) -> Column:
        return F.array(*[_entry(_column(F.col("all"), first + j)) for j in range(entries)])

    return found.select("bucket", "row", of_version(0).alias("entries"), of_version(entries).alias("edited_entries"))


def _column(rows: Column, j: int) -> Column:
    return F.filter(F.transform(rows, lambda r: r[j]), lambda v: v.isNotNull())


def likeness(x: Column, y: Column) -> Column:
    """The share of equal entries."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) / F.size(x)


def as_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 16, "0")), "")


def cuts(docs: DataFrame, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(bucket, did, tie) of the first row of each bucket, by ranges of (did, tie) that Spark's sampled splitters cut; ``most`` rows at most."""
    ids = docs.select(did().alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    parts = min(most, max(1, math.ceil(ids.count() / rows)))
    ranged = ids.repartitionByRange(parts, "did", "tie").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("did", "tie")).alias("first"))
    numbered = ranged.select((F.row_number().over(Window.orderBy("first")) - 1).alias("bucket"), "first.*")
    return written(numbered, "cuts")


def bucket_of(did_: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Of sorted (did, tie) ``bounds``, the index (from 0) of the last one that is at most the row's: binary search in constant arrays."""
    if len(bounds) < 2:
        return F.lit(0)
    dids, ties = (F.split(F.lit(",".join(str(b[k]) for b in bounds)), ",").cast("array<long>") for k in (0, 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.least(mid + 1, F.lit(len(bounds)))
        low = F.element_at(dids, at)
        right = (low < did_) | ((low == did_) & (F.element_at(ties, at) <= tie))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~right, mid).otherwise(s["hi"]).alias("hi"))

    return F.greatest(F.aggregate(steps, start, halve)["lo"] - 1, F.lit(0))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """bucket, row, did, tie, text, next_text, guest: each document beside the next one by id, the last beside the first."""
    firsts = cuts(docs, rows)
    bounds = sorted((r["did"], r["tie"]) for r in firsts.select("did", "tie").collect())  # MOST rows at most
    given = docs.select(did().alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # a bucket's first row visits the bucket before, the first of all the last one
    last = F.max("bucket").over(Window.partitionBy())
    visiting = firsts.select("did", "tie", F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("bucket"))
    guests = given.join(F.broadcast(visiting), ["did", "tie"]).select("did", "text", "tie", "bucket", F.lit(True).alias("guest"))
    own = given.select("did", "text", "tie", bucket_of(F.col("did"), F.col("tie"), bounds).alias("bucket"), F.lit(False).alias("guest"))
    both = own.unionByName(guests)
    parts = min(MOST, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(bounds)))
    order = Window.partitionBy("bucket").orderBy("guest", "did", "tie")
    return both.repartition(parts, "bucket").select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 4) characters replaced by the first as many of ``following``."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - cut), F.substr(following, F.lit(1), cut))


def digest(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The contract's columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs = with_next(docs, rows)
    # guests only lend their text and fingerprint
    both = pairs.withColumn("edited", F.when(~F.col("guest"), edited(F.col("text"), F.coalesce("next_text", F.lit("")))))
    info = both.filter(~F.col("guest")).select(
        "bucket", "row", "did", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    )
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    head = F.regexp_replace(F.substr("text", F.lit(1), kept), F.lit(r"[^\x20\x09-\x0D]+\z"), F.lit(""))
    cut = both.select("bucket", "row", "text", "edited", F.when(F.col("guest"), F.lit("")).otherwise(head).alias("head"))
    after = lambda c: F.substr(F.col(c), F.length("head") + 1).alias(c)
    own = fingerprints(cut.select("bucket", "row", "head", after("text"), after("edited")))
    following = F.lead("entries").over(Window.partitionBy("bucket").orderBy("row"))
    out = own.withColumn("following", following).join(info, ["bucket", "row"])
    return out.select(
        real_id().alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("entries")).alias("fingerprint"),
        as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("following")).alias("near_next"),
    )

"""Line dedup with DataFrame functions only.

Lines are exploded with their position, normalised and hashed (MD5: 128 bits); distinct documents are counted per hash;
dropped positions come back to their row and the text is put together again from the stretches of lines between them.
Texts move through one shuffle.

A document is an id, so a line counts once for all rows of an id. The first aggregate is by (hash, id), which spreads a hot
line over the tasks; the second has one partial count a task for it. The ``HOT_LINES`` lines in most documents, a bounded
set, are told by a broadcast; their rows do not meet in a task but go on under a key of their own.

Defined cases: a null or empty text is one empty line; null ids are one document, less than any other id; rows of one id
keep the line alike if the id is the largest that holds it; fully repeated rows get equal results, one each; with no rows
the result has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_SPACE, did, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines told by a broadcast, at most (about 50 bytes each).
HOT_LINES = 2000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    lowered = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(ascii_only, F.lower(bare)).otherwise(lowered)


def _long(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(ASCII_SPACE))) >= min_chars


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line_hash, n_docs, keeper): hashes of keys of at least ``min_chars`` in at least ``min_docs`` documents; ``keeper`` is the largest id."""
    hashes = F.array_distinct(
        F.transform(F.filter(lines_of(F.col("text")), lambda x: _long(x, min_chars)), lambda x: F.md5(line_key(x)))
    )
    return (
        docs.select(did().alias("did"), F.explode(hashes).alias("line_hash"))
        .groupBy("line_hash", "did")
        .agg(F.lit(1).alias("one"))
        .groupBy("line_hash")
        .agg(F.count("*").alias("n_docs"), F.max("did").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines``, ``n_dropped`` under the struct ``line_dedup``."""
    bad = written(repeated_lines(docs, min_chars, min_docs), "lines")
    hot = bad.orderBy(F.desc("n_docs"), "line_hash").limit(HOT_LINES).select("line_hash", F.col("keeper").alias("hot_keeper"))
    bad = bad.select(F.col("line_hash").alias("bad_hash"), "keeper")
    thash = F.xxhash64("text")
    places = (
        docs.select(did().alias("did"), thash.alias("thash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .filter(_long(F.col("line"), min_chars))
        .select("did", "thash", "pos", F.md5(line_key(F.col("line"))).alias("line_hash"))
    )
    known = places.join(F.broadcast(hot), "line_hash", "left")
    # told already: any key will do that spreads them and is no hash
    known = known.withColumn("key", F.when(F.col("hot_keeper").isNull(), F.col("line_hash")).otherwise(F.concat(F.lit("-"), F.pmod("did", F.lit(1_000_003)))))
    gone = (
        known.join(bad, F.col("key") == F.col("bad_hash"), "left")
        .filter(F.col("did") != F.coalesce("hot_keeper", "keeper"))
        .groupBy("did", "thash")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .withColumnsRenamed({"did": "__did", "thash": "__thash", "gone": "__gone"})
    )
    whole = docs.withColumns({"__d": did(), "__t": thash})
    joined = whole.join(gone, (F.col("__d") == F.col("__did")) & (F.col("__t") == F.col("__thash")), "left")
    stops = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    shaped = joined.withColumns({"__lines": lines_of(F.col("text")), "__stops": stops})
    n, m = F.size("__lines"), F.size("__stops")
    # between dropped positions: start (1-based) after the one before, up to the next
    before = F.concat(F.array(F.lit(-1)), F.col("__stops"))
    after = F.concat(F.col("__stops"), F.array(n))
    spans = F.arrays_zip(before.alias("a"), after.alias("b"))
    kept = F.flatten(F.transform(spans, lambda s: F.slice(F.col("__lines"), s["a"] + 2, s["b"] - s["a"] - 1)))
    columns = [F.array_join(kept, "\n").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    info = F.struct(n.cast("long").alias("n_lines"), m.cast("long").alias("n_dropped")).alias("line_dedup")
    return shaped.select(*columns, info)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT rid, doc_id, did, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), bad AS (
  SELECT key, max(did) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT did) >= 5
), marked AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, bad.key IS NOT NULL AND k.did <> bad.keeper AS gone FROM k LEFT JOIN bad ON k.key = bad.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

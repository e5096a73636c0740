"""Statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import chars as C
from textloom.functions.core import let, lines, rx

#: Words a minute read in silence and aloud, and words that frequency lists leave out (fixed values).
READING, SPEAKING = 238, 140
STOP_WORDS = (
    "the and for that with this from are was were have has had you your our their they them but not all can will would should "
    "could been its into than then there these those what when which who how why more most some such only other any"
)
WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}'\\x{2019}._-]*"
SENTENCE_END = f"[.!?\\x{{2026}}]+[{C.WS_BODY}{C.body(C.CLOSE_QUOTE_POINTS)})]|\\n"
METRICS = (
    "characters charactersNoSpaces words uniqueWords sentences paragraphs lines bytes longestLine readingMinutes speakingMinutes averageWordLength"
)


def words_of(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def compute_stats(t: Column) -> Column:
    """A struct of the metrics; all zero for an empty or null text."""
    text = F.coalesce(t, F.lit(""))
    filled = lambda parts: F.size(F.filter(parts, lambda x: x.rlike(C.NOT_WS)))

    def build(ws: Column) -> Column:
        n = F.size(ws)
        letters = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
        ls = lines(text)
        return F.struct(
            F.length(text).cast("long").alias("characters"),
            F.length(rx(text, f"{C.WS}+")).cast("long").alias("charactersNoSpaces"),
            n.cast("long").alias("words"),
            F.size(F.array_distinct(F.transform(ws, F.lower))).cast("long").alias("uniqueWords"),
            filled(F.split(text, SENTENCE_END, -1)).cast("long").alias("sentences"),
            filled(F.split(text, f"\\n{C.WS}*\\n", -1)).cast("long").alias("paragraphs"),
            F.when(text == "", 0).otherwise(F.size(ls)).cast("long").alias("lines"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.array_max(F.transform(ls, F.length)).cast("long").alias("longestLine"),
            (n / F.lit(float(READING))).alias("readingMinutes"),
            (n / F.lit(float(SPEAKING))).alias("speakingMinutes"),
            F.when(n > 0, letters / n).otherwise(0.0).alias("averageWordLength"),
        )

    return let(words_of(text), build)


def doc_stats(df: DataFrame, column: str = "text") -> DataFrame:
    """The other columns of ``df`` and the metrics."""
    rest = [c for c in df.columns if c != column]
    return df.withColumn("__s", compute_stats(F.col(column))).select(*rest, "__s.*")


def word_frequency(df: DataFrame, key: str | None, column: str = "text", limit: int = 12, min_length: int = 3, stop_words: bool = True) -> DataFrame:
    """(key, rank, word, count): the most frequent words of each document, or of all with no key.

    Ties go to the word met first, over a whole corpus to the first in order. ``limit`` is the report's size.
    """
    bare = rx(F.lower(F.col("w")), "^[._-]+|[._-]+\\z")
    keys = [key] if key else []
    rows = df.select(*keys, F.posexplode(words_of(F.coalesce(F.col(column), F.lit("")))).alias("pos", "w")).select(*keys, "pos", bare.alias("word"))
    rows = rows.filter(F.length("word") >= min_length)
    if stop_words:
        rows = rows.filter(~F.col("word").isin(STOP_WORDS.split()))
    counted = rows.groupBy(*keys, "word").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    if not key:
        return counted.orderBy(F.desc("count"), "word").limit(limit).select("word", "count")
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select(key, "rank", "word", "count")


def summarise_change(before: Column, after: Column) -> Column:
    """How much a text changed."""
    return let(
        F.struct(compute_stats(before).alias("b"), compute_stats(after).alias("a")),
        lambda s: F.struct(
            (s["b"]["characters"] - s["a"]["characters"]).alias("charactersRemoved"),
            (s["b"]["lines"] - s["a"]["lines"]).alias("linesRemoved"),
            (s["a"]["words"] - s["b"]["words"]).alias("wordsChanged"),
            (~before.eqNullSafe(after)).alias("changed"),
        ),
    )


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def format_duration(minutes: Column) -> Column:
    whole = lambda c: _half_up(c).cast("string")
    return (
        F.when(minutes.isNull() | (minutes == 0), "0 sec")
        .when(minutes < 1, F.concat(F.greatest(F.lit(1), _half_up(minutes * 60)).cast("string"), F.lit(" sec")))
        .when(minutes < 60, F.concat(whole(minutes), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hr "), whole(minutes - F.floor(minutes / 60) * 60), F.lit(" min")))
    )


def _one_place(x: Column) -> Column:
    """One decimal, of the exact value of the double and halves upwards: below 4096 in units of 2^-50, which are exact."""
    x = x.cast("double")
    units = (x * F.lit(float(1 << 50))).cast("bigint")
    rest = units.bitwiseAND(F.lit((1 << 50) - 1))
    tenths = F.shiftright(units, 50) * 10 + F.shiftright(rest * 10 + F.lit(1 << 49), 50)
    exact = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(F.abs(x) < 4096, exact).otherwise(F.format_string("%.1f", x))


def format_count(value: Column) -> Column:
    """Grouped by commas below 10,000, then k and M."""
    short = lambda size, unit: F.concat(F.regexp_replace(_one_place(value / size), "\\.0$", ""), F.lit(unit))
    return F.when(value < 10_000, F.format_number(value, 0)).when(value < 1_000_000, short(1000.0, "k")).otherwise(short(1e6, "M"))


def format_bytes(value: Column) -> Column:
    return (
        F.when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < 1024 * 1024, F.concat(_one_place(value / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(_one_place(value / 1048576.0), F.lit(" MB")))
    )

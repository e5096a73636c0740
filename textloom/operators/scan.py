"""The problem scanner and the character inspector."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import chars as C
from textloom.functions import linewise, markup, repair
from textloom.functions.core import let, lines, rx, trim
from textloom.operators.wording import CHECK_DETAILS, CHECK_LABELS


#: What checks look at: the text, its lines, and whether it holds anything but ASCII.
Given = Column


def _count(pattern: str) -> Callable[[Given], Column]:
    return lambda g: F.regexp_count(g["text"], F.lit(pattern))


def _odd(pattern: str) -> Callable[[Given], Column]:
    """For patterns that need a character beyond ASCII."""
    return lambda g: F.when(g["odd"], F.regexp_count(g["text"], F.lit(pattern))).otherwise(0)


def _lines(pattern: str) -> Callable[[Given], Column]:
    return lambda g: F.size(F.filter(g["lines"], lambda x: x.rlike(pattern)))


def _outside_emoji(points: str) -> Callable[[Given], Column]:
    held = f"[{C.body(points)}]"
    return lambda g: F.when(g["odd"] & g["text"].rlike(held), F.regexp_count(rx(g["text"], C.GLUE), F.lit(held))).otherwise(0)


def hard_wraps(given: Given) -> Column:
    """Breaks inside a sentence, in a text whose lines look cut to a width."""

    def found(ls: Column) -> Column:
        longest = F.array_max(F.transform(ls, lambda x: F.length(x)))

        def cut(longest: Column) -> Column:
            pairs = F.arrays_zip(F.slice(ls, 1, F.size(ls) - 1).alias("a"), F.slice(ls, 2, F.size(ls) - 1).alias("b"))

            def broken(p: Column) -> Column:
                a, b = p["a"], p["b"]
                return ~linewise.is_list_item(a) & ~linewise.is_list_item(b) & ~a.rlike("[.!?:;]\\z") & b.rlike("^[\\p{Ll}0-9]") & (F.length(a) > longest * 0.6)

            return F.when(longest > 200, 0).otherwise(F.size(F.filter(pairs, broken)))

        return F.when(F.size(ls) < 3, 0).otherwise(let(longest, cut))

    return F.when(F.size(given["lines"]) < 3, 0).otherwise(let(given["bare"], found))


def running_heads(given: Given) -> Column:
    """Lines of up to 80 characters among those found three times or more."""
    count = lambda s: F.size(F.filter(s, lambda k, j: linewise.in_run(lambda i: F.get(s, i), j, 3)))
    return F.when(F.size(given["bare"]) < 3, 0).otherwise(let(F.array_sort(F.filter(given["bare"], lambda k: F.length(k) <= 80)), count))


def duplicate_lines(given: Given) -> Column:
    return F.size(given["bare"]) - F.size(F.array_distinct(given["bare"]))


_LOW = "\\p{Ll}"
#: Checks in order: id, severity, operations that help, count (fixed ids and severities).
CHECKS: tuple[tuple[str, str, str, Callable[[Given], Column]], ...] = (
    ("mojibake", "high", "fixMojibake", _odd(C.MOJIBAKE_HINT)),
    ("replacementChar", "high", "removeControls", _odd("\\x{FFFD}")),
    ("tagChars", "high", "removeInvisibles", _outside_emoji(C.TAG_POINTS)),
    ("bidi", "high", "removeInvisibles", _odd(f"[{C.body(C.BIDI_POINTS)}]")),
    ("html", "high", "htmlToText", lambda g: F.when(markup.looks_like_html(g["text"]), F.regexp_count(g["text"], F.lit("(?i)<[a-z!/][^>]*>"))).otherwise(0)),
    ("hardWrap", "high", "unwrapParagraphs", hard_wraps),
    ("hyphenBreaks", "high", "unwrapParagraphs dehyphenate", _count(f"{_LOW}{linewise.HYPHEN}\\n{C.HS}*{_LOW}")),
    ("invisibles", "medium", "removeInvisibles", _outside_emoji(C.INVISIBLE_POINTS)),
    ("controls", "medium", "removeControls", _count(f"[{C.body(C.CONTROL_POINTS)}]")),
    ("objects", "medium", "removeControls", _odd(f"[{C.body(C.OBJECT_POINTS)}]")),
    ("privateUse", "medium", "removeControls", _odd(f"[{C.body(C.PRIVATE_POINTS)}]")),
    ("nbsp", "medium", "normaliseSpaces", _odd(f"[{C.body(C.EXOTIC_POINTS)}]")),
    ("ligatures", "medium", "expandLigatures", _odd("[" + "".join(C.LIGATURES) + "]")),
    ("entities", "medium", "decodeEntities", _count(f"(?i){markup.ENTITY}")),
    ("emailQuoting", "medium", "removeEmailQuoting", _lines("^[ \\t]*>")),
    ("pageNumbers", "medium", "removePageNumbers", _lines(f"(?:{linewise.PAGE_NUMBERS[0]})|(?:{linewise.PAGE_NUMBERS[2]})")),
    ("runningHeads", "medium", "removeRepeatedLines", running_heads),
    ("smartQuotes", "low", "straightenQuotes", _odd(f"[{C.body(C.SMART_QUOTE_POINTS)}]")),
    ("dashes", "low", "straightenDashes", _odd(f"[{C.body(C.SMART_DASH_POINTS)}]")),
    ("bullets", "low", "normaliseListMarkers", _lines(f"^[ \\t]*[{C.body(C.BULLET_POINTS)}{C.body(C.PRIVATE_POINTS)}]")),
    ("duplicateLines", "low", "deduplicateLines", duplicate_lines),
    ("multiSpace", "low", "collapseSpaces", _count(f"{C.NOT_WS}{C.HS}{{2,}}{C.NOT_WS}")),
    ("trailingSpace", "low", "trimLines", _count(f"(?md){C.HS}+$")),
    ("tabs", "low", "tabsToSpaces", _count("\\t")),
    ("blankRuns", "low", "collapseBlankLines", _count("\\n{3,}")),
    ("spaceBeforePunctuation", "low", "fixSpaceBeforePunctuation", _count(f"{C.WS}+[,.;:!?]")),
    ("trackingLinks", "low", "cleanUrls", _count("(?i)[?&](?:utm_\\w+|fbclid|gclid|mc_[ce]id|igshid|msclkid)=")),
    ("emoji", "low", "removeEmoji", _count(C.EMOJI)),
)
SEVERITIES = ("high", "medium", "low")


def given_of(t: Column) -> Given:
    bare = lambda ls: F.filter(F.transform(ls, trim), lambda x: x != "")
    return let(lines(t), lambda ls: F.struct(t.alias("text"), ls.alias("lines"), bare(ls).alias("bare"), t.rlike("[^\\x{0}-\\x{7F}]").alias("odd")))


def counts_of(t: Column, names: Iterable[str] | None = None) -> Column:
    """One struct with a count for each check (or those named)."""
    wanted = set(names) if names is not None else None
    return let(given_of(t), lambda g: F.struct(*[f(g).cast("int").alias(i) for i, _, _, f in CHECKS if wanted is None or i in wanted]))


def scan_wide(df: DataFrame, column: str = "text") -> DataFrame:
    """The other columns of ``df`` and a column for each check."""
    rest = [c for c in df.columns if c != column]
    counted = df.withColumn(column, counts_of(F.coalesce(F.col(column), F.lit(""))))
    return counted.select(*rest, *[F.col(column)[i].cast("long").alias(i) for i, *_ in CHECKS])


def issues(t: Column) -> Column:
    """Problems found, gravest first, then most frequent, then in the order of the checks."""
    rows = lambda c: F.array(
        *[
            F.struct(
                F.lit(SEVERITIES.index(s)).alias("rank"), (-c[i]).alias("less"), F.lit(n).alias("ordinal"), F.lit(i).alias("id"),
                F.lit(s).alias("severity"), F.lit(CHECK_LABELS[i]).alias("label"), F.lit(CHECK_DETAILS.get(i)).cast("string").alias("detail"),
                c[i].alias("count"), F.array(*map(F.lit, ops.split())).alias("ops"),
            )
            for n, (i, s, ops, _) in enumerate(CHECKS)
        ]
    )
    found = let(counts_of(F.coalesce(t, F.lit(""))), lambda c: F.array_sort(F.filter(rows(c), lambda r: r["count"] > 0)))
    return F.transform(found, lambda r: F.struct(*[r[k].alias(k) for k in ("id", "severity", "label", "detail", "count", "ops")]))


def scan_long(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, position, id, severity, count), a row for each problem found."""
    rows = df.select(key, F.posexplode(issues(F.col(column))).alias("position", "issue"))
    return rows.select(key, F.col("position").cast("long"), "issue.id", "issue.severity", F.col("issue.count").cast("long").alias("count"))


def code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def label(cp: Column) -> Column:
    """``U+00A0``."""
    h = F.hex(cp)
    return F.concat(F.lit("U+"), F.repeat(F.lit("0"), F.greatest(4 - F.length(h), F.lit(0))), h)


def name(cp: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.CHARACTER_NAMES.items() for x in pair])
    between = lambda a, b: (cp >= a) & (cp <= b)
    kind = (
        F.when(between(0xE0000, 0xE007F), "invisible tag character")
        .when(between(0xE000, 0xF8FF), "private-use glyph (font-specific)")
        .when(between(0x300, 0x36F), "combining accent")
        .when((cp < 0x20) | between(0x7F, 0x9F), "control character")
        .when(cp >= 0x1F000, "emoji or pictograph")
        .otherwise("non-ASCII character")
    )
    return F.coalesce(F.try_element_at(known, cp), kind)


def printable(cp: Column) -> Column:
    hidden = F.lit(False)
    for a, b in C.ranges(C.UNPRINTABLE_POINTS):
        hidden = hidden | ((cp >= a) & (cp <= b))
    return ~hidden


def inspect_characters(df: DataFrame, key: str, column: str = "text", limit: int = 200) -> DataFrame:
    """(key, rank, code_point, count, label, name, char, printable) of unusual characters, the most frequent first.

    Ties go to the character met first. ``limit`` rows a document are the report's size.
    """
    odd = rx(F.coalesce(F.col(column), F.lit("")), "[\\n\\t -~]")
    chars = df.select(key, F.posexplode(F.split(odd, "")).alias("pos", "char")).filter("char <> ''")
    counted = chars.groupBy(key, "char").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    cp = F.col("code_point")
    return ranked.withColumn("code_point", code_point(F.col("char"))).select(
        key, F.col("rank").cast("long"), cp.cast("long"), "count", label(cp).alias("label"), name(cp).alias("name"), "char", printable(cp).alias("printable")
    )


#: Unprintable characters other than line feeds, tabs and unusual spaces (fixed values).
HIDDEN_POINTS = "0-8 B-1F 7F-9F 200B-200F 2028-202E 2060-206F FE00-FE0F FEFF FFFC E000-F8FF E0000-E007F"
#: Kinds of marks, with the class of characters that each takes; what is left over is ``other``.
MARKS = (("tab", "\\t"), ("space", C.body(C.EXOTIC_POINTS)), ("invisible", C.body(HIDDEN_POINTS)))


def marked(t: Column) -> Column:
    """The text in pieces (kind, text, title), for showing what is hidden in it: runs of plain text, and each other character.

    Kinds: plain, tab, space (looks like one), invisible, other. Invisible characters are shown by their label.
    """
    pieces = F.regexp_extract_all(repair.newlines(F.coalesce(t, F.lit(""))), F.lit("[\\n -~]+|[^\\n -~]"), F.lit(0))

    def one(p: Column) -> Column:
        kind = F.when(p.rlike("^[\\n -~]"), "plain")
        for k, body in MARKS:
            kind = kind.when(p.rlike(f"^[{body}]"), k)

        def shown(kind: Column) -> Column:
            cp = F.when(kind != "plain", code_point(p))
            named = F.concat(name(cp), F.lit(" ("), label(cp), F.lit(")"))
            title = F.when(kind == "tab", "tab").when(kind == "space", F.concat(named, F.lit(": looks like a space, but is not one"))).when(kind != "plain", named)
            return F.struct(kind.alias("kind"), F.when(kind == "invisible", label(cp)).otherwise(p).alias("text"), title.alias("title"))

        return let(kind.otherwise("other"), shown)

    return F.transform(pieces, one)


def mark_counts(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, tab, space, invisible, other): how many marks of each kind."""
    kinds = F.transform(marked(F.col(column)), lambda m: m["kind"])
    of = lambda k: F.size(F.filter(F.col("kinds"), lambda x: x == k)).cast("long").alias(k)
    return df.select(key, kinds.alias("kinds")).select(key, *[of(k) for k in ("tab", "space", "invisible", "other")])

"""Lines and paragraphs, as array expressions: no shuffle, order kept, usable on streams.

Sorting and repeats inside a text use sorted arrays of (key, place), so long texts cost n log n.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from statistics import median

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import chars as C
from textloom.functions.core import each_line, java_pattern, keep_lines, let, lines, literal, python, quoted, rx, trim, unlines, valid_pattern

_MARK = C.body(C.MARKER_POINTS)
_OPEN, _CLOSE = C.body(C.OPEN_QUOTE_POINTS), C.body(C.CLOSE_QUOTE_POINTS)
_NUMBER = "(?:\\(?[0-9]{1,3}[.)\\]]|\\(?[a-zA-Z][.)\\]]|[ivxlcIVXLC]{1,5}[.)])"
BULLET_START = f"^[ \\t]*[{_MARK}][ \\t]+"
NUMBER_START = f"^[ \\t]*{_NUMBER}[ \\t]+"
HYPHEN = "[-\\x{AD}]"
_DASH = "-\\x{2013}\\x{2014}"
#: Lines that hold a page number and nothing else (fixed values).
PAGE_NUMBERS = (
    f"^{C.WS}*[0-9]{{1,4}}{C.WS}*\\z",
    f"^{C.WS}*[{_DASH}\\[(]?{C.WS}*[0-9]{{1,4}}{C.WS}*[{_DASH}\\])]?{C.WS}*\\z",
    f"(?i)^{C.WS}*page{C.WS}+[0-9]{{1,4}}({C.WS}+of{C.WS}+[0-9]{{1,4}})?{C.WS}*\\z",
    f"^{C.WS}*[0-9]{{1,4}}{C.WS}*[|/]{C.WS}*[0-9]{{1,4}}{C.WS}*\\z",
    f"(?i)^{C.WS}*[ivxlcdm]{{1,7}}{C.WS}*\\z",
)


def remove_email_quoting(t: Column, dropQuotedText: bool = False) -> Column:
    if dropQuotedText:
        return keep_lines(t, lambda x: ~x.rlike("^[ \\t]*>"))
    return rx(t, "(?md)^[ \\t]*(?:>[ \\t]?)+")


def is_list_item(line: Column) -> Column:
    return line.rlike(BULLET_START) | line.rlike(NUMBER_START)


def remove_list_markers(t: Column, bullets: bool = True, numbers: bool = True) -> Column:
    t = rx(t, f"(?md)^([ \\t]*)[{_MARK}][ \\t]+", "$1") if bullets else t
    return rx(t, f"(?md)^([ \\t]*){_NUMBER}[ \\t]+", "$1") if numbers else t


def normalise_list_markers(t: Column, marker: str = "- ") -> Column:
    return rx(t, f"(?md)^([ \\t]*)[{_MARK}][ \\t]+", "$1" + quoted(marker))


def remove_page_numbers(t: Column) -> Column:
    return keep_lines(t, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in PAGE_NUMBERS)))


def in_run(keys: Callable[[Column], Column], j: Column, times: int) -> Column:
    """Whether place j of sorted ``keys`` lies in a run of at least ``times`` equal ones: some stretch of that many around it has equal ends."""
    out = F.lit(False)
    for before in range(times):
        first, last = keys(j - before), keys(j + (times - 1 - before))
        out = out | F.coalesce((first == last) & (j >= before), F.lit(False))
    return out


def remove_repeated_lines(t: Column, minOccurrences: int = 3, maxLength: int = 80) -> Column:
    """Lines that may count have a key; the others, with a null key, always stay."""
    if minOccurrences <= 0:
        return F.lit("")

    def key(x: Column) -> Column:
        bare = trim(x)
        return F.when((bare != "") & (F.length(bare) <= maxLength), bare)

    kept = lambda pairs: F.filter(pairs, lambda p, j: ~in_run(lambda i: F.get(pairs, i)["k"], j, minOccurrences))
    return unlines(let(lines(t), lambda ls: _at(ls, let(_by_key(ls, key), kept))))


def dehyphenate(t: Column) -> Column:
    return rx(t, f"(\\p{{Ll}}){HYPHEN}\\n{C.HS}*(\\p{{Ll}})", "$1$2")


_SPACES = C.characters(C.SPACE_POINTS)
_GAP = re.compile(f"[{re.escape(_SPACES)}]+")
_ITEM = re.compile(rf"[ \t]*(?:[{re.escape(C.characters(C.MARKER_POINTS))}]|\(?[0-9]{{1,3}}[.)\]]|\(?[a-zA-Z][.)\]]|[ivxlcIVXLC]{{1,5}}[.)])[ \t]+")
_ENDING = frozenset(".!?:;)]" + C.characters(C.CLOSE_QUOTE_POINTS))
_OPENING = frozenset("0123456789" + C.characters(C.OPEN_QUOTE_POINTS))
_SPLIT = frozenset("-" + chr(0xAD))
#: Below this share of the column, and this many characters short of it, a line may end a paragraph.
SHORT, GAP = 0.65, 25


def _heading(x: str) -> bool:
    """A short line without a closing mark that is shouted or starts with number signs."""
    if not x or len(x) > 80 or x[-1] in ".,;:":
        return False
    if x[0] == "#":
        bare = x.lstrip("#")
        if len(x) - len(bare) <= 6 and bare[:1] and bare[0] in _SPACES:
            return True
    letters = "".join(c for c in x if unicodedata.category(c)[0] == "L")
    return len(letters) > 3 and letters == letters.upper()


def _is_lower(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def _column_width(rows: list[str]) -> float:
    """The median of the upper half of the widths."""
    widths = [len(x) for x in rows if x]
    middle = median(widths) if widths else 0
    upper = [n for n in widths if n >= middle]
    return median(upper) if upper else 0


class _Paragraph:
    """A paragraph being joined from lines: its pieces, its length so far and what its two ends look like."""

    def __init__(self, line: str, bare: str):
        self.line, self.bare, self.pieces, self.size = line, bare, [bare], len(bare)
        self.item = bool(_ITEM.match(bare))

    def heading(self) -> bool:
        return self.size <= 80 and _heading("".join(self.pieces))

    def ends(self, nxt: str, width: float) -> bool:
        """Whether the paragraph stops before the line ``nxt``."""
        if not self.size or not nxt or self.item or _ITEM.match(nxt) or self.heading() or _heading(nxt):
            return True
        last = self.pieces[-1][-1]
        if last in _SPLIT or not width > 0 or self.size >= width * SHORT:
            return False
        return last in _ENDING or nxt[0] in _OPENING or unicodedata.category(nxt[0]) == "Lu" or width - self.size > GAP

    def take(self, nxt: str, rejoin: bool) -> None:
        last = self.pieces[-1]
        if rejoin and len(last) > 1 and last[-1] in _SPLIT and _is_lower(last[-2]) and _is_lower(nxt[0]):
            self.pieces[-1] = last[:-1] + nxt
            self.size += len(nxt) - 1
        else:
            self.pieces += [" ", nxt]
            self.size += len(nxt) + 1
        self.line = None

    def text(self) -> str:
        """As it stood if nothing was joined; else with the first line's indent."""
        if self.line is not None:
            return self.line
        return self.indent + "".join(self.pieces)

    indent = ""


def unwrapped(block: str, rejoin: bool = True) -> str:
    rows = block.split("\n")
    if len(rows) < 2:
        return block
    bare = [x.strip(_SPACES) for x in rows]
    width, out = _column_width(bare), []
    now = _Paragraph(rows[0], bare[0])
    now.indent = rows[0][: len(rows[0]) - len(rows[0].lstrip(_SPACES))]
    for row, nxt in zip(rows[1:], bare[1:], strict=True):
        if now.ends(nxt, width):
            out.append(now.text())
            now = _Paragraph(row, nxt)
            now.indent = row[: len(row) - len(row.lstrip(_SPACES))]
        else:
            now.take(nxt, rejoin)
    return "\n".join([*out, now.text()])


@python
def unwrap_paragraphs(t: Column, dehyphenate: bool = True) -> Column:
    """Joins lines that a column width broke; breaks that end a paragraph, a list item or a heading stay.

    The fold over lines costs a quadratic in column expressions, which carry the whole joined line from step to step;
    Arrow batches keep it linear.
    """

    @F.pandas_udf(StringType())
    def whole(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or "\n" not in x else "\n\n".join(unwrapped(b, dehyphenate) for b in re.split("\n{2,}", x)))

    return whole(t)


def remove_all_line_breaks(t: Column, separator: str = " ") -> Column:
    return F.array_join(F.filter(F.transform(lines(t), trim), lambda x: x != ""), separator)


def remove_empty_lines(t: Column) -> Column:
    return keep_lines(t, lambda x: x.rlike(C.NOT_WS))


def collapse_blank_lines(t: Column, max: int = 1) -> Column:  # noqa: A002
    return rx(t, "\\n{2,}", "\n" * ((max if max > 0 else 0) + 1))


def double_space_lines(t: Column) -> Column:
    return F.replace(t, F.lit("\n"), F.lit("\n\n"))


def _by_key(ls: Column, key) -> Column:
    """Sorted (key, place) of lines."""
    return F.array_sort(F.transform(ls, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))


def _at(ls: Column, chosen: Column) -> Column:
    """The lines at the places of ``chosen``, in order."""
    return F.transform(F.array_sort(F.transform(chosen, lambda p: p["i"])), lambda i: F.element_at(ls, i + 1))


def _key_before(pairs: Column, j: Column) -> Column:
    return F.when(j > 0, F.get(pairs, j - 1)["k"])


def deduplicate_lines(t: Column, caseSensitive: bool = False, adjacentOnly: bool = False) -> Column:
    key = trim if caseSensitive else lambda x: F.lower(trim(x))
    if adjacentOnly:
        keys = lambda ls: let(
            F.transform(ls, key), lambda ks: F.filter(ls, lambda x, i: (i == 0) | (F.get(ks, i) != F.get(ks, F.greatest(i - 1, F.lit(0)))))
        )
        return unlines(let(lines(t), keys))
    first = lambda pairs: F.filter(pairs, lambda p, j: (p["k"] == "") | ~p["k"].eqNullSafe(_key_before(pairs, j)))
    return unlines(let(lines(t), lambda ls: _at(ls, let(_by_key(ls, key), first))))


def keep_duplicate_lines(t: Column) -> Column:
    """The first of each non-empty line that occurs again."""

    def again(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, j: (p["k"] != "") & p["k"].eqNullSafe(F.get(pairs, j + 1)["k"]) & ~p["k"].eqNullSafe(_key_before(pairs, j)))

    return unlines(let(lines(t), lambda ls: _at(ls, let(_by_key(ls, trim), again))))


def filter_lines(t: Column, pattern: str = "", mode: str = "keep", regex: bool = False, ignoreCase: bool = True) -> Column:
    """An empty or bad pattern leaves the text as it is."""
    java = java_pattern(pattern) if regex else literal(pattern)
    if not pattern or not valid_pattern(java):
        return t
    java = f"(?iu){java}" if ignoreCase else java
    return keep_lines(t, lambda x: x.rlike(java) if mode == "keep" else ~x.rlike(java))


def collation_key(x: Column) -> Column:
    """Natural order without accents and case: digits padded to 20 places, compared by the root collation."""
    padded = rx(rx(x, "([0-9]+)", "0" * 20 + "$1"), "0*([0-9]{20})(?![0-9])", "$1")
    return F.collate(padded, "UNICODE_CI_AI")


def sort_lines(t: Column, order: str = "asc", ignoreCase: bool = True) -> Column:
    """Stable. Orders: asc, desc, length, lengthDesc, reverse, shuffle (random); anything else is asc."""
    if order == "reverse":
        return unlines(F.reverse(lines(t)))
    if order == "shuffle":
        return unlines(F.shuffle(lines(t)))
    n = lambda x: F.length(trim(x))
    name = collation_key if ignoreCase else lambda x: x
    if order in ("length", "lengthDesc"):
        sign = 1 if order == "length" else -1
        rows = lambda ls: F.transform(ls, lambda x, i: F.struct((n(x) * sign).alias("n"), collation_key(x).alias("k"), i.alias("i"), x.alias("x")))
        return unlines(F.transform(F.array_sort(rows(lines(t))), lambda r: r["x"]))
    if order == "desc":
        rows = lambda ls: F.transform(ls, lambda x, i: F.struct(name(x).alias("k"), (-i).alias("i"), x.alias("x")))
        return unlines(F.transform(F.sort_array(rows(lines(t)), asc=False), lambda r: r["x"]))
    rows = lambda ls: F.transform(ls, lambda x, i: F.struct(name(x).alias("k"), i.alias("i"), x.alias("x")))
    return unlines(F.transform(F.array_sort(rows(lines(t))), lambda r: r["x"]))


def _filled(line: str, limit: int, break_long: bool) -> str:
    """One line cut greedily between words; with ``break_long``, full pieces of a long word stand alone."""
    if len(line) <= limit:
        return line
    indent = line[: len(line) - len(line.lstrip(" \t"))]
    room, out, now = max(1, limit - len(indent)), [], ""
    for word in filter(None, _GAP.split(line)):
        while break_long and len(word) > room:
            if now:
                out.append(indent + now)
                now = ""
            out.append(indent + word[:room])
            word = word[room:]
        if now and len(indent) + len(now) + 1 + len(word) > limit:
            out.append(indent + now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return "\n".join(out + [indent + now] * bool(now))


@python
def wrap_lines(t: Column, width: int = 80, breakLongWords: bool = False) -> Column:
    """Greedy filling up to the width (10 at least); the indent is repeated on each new line. In Arrow batches, linear in the text."""
    limit = max(10, width)

    @F.pandas_udf(StringType())
    def whole(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or len(x) <= limit else "\n".join(_filled(line, limit, breakLongWords) for line in x.split("\n")))

    return whole(t)


def number_lines(t: Column, start: int = 1, separator: str = ". ", pad: bool = False) -> Column:
    def numbered(ls: Column) -> Column:
        width = F.length((F.size(ls) + (start - 1)).cast("string"))

        def one(x: Column, i: Column) -> Column:
            n = (i + start).cast("string")
            shown = F.concat(F.repeat(F.lit(" "), F.greatest(width - F.length(n), F.lit(0))), n) if pad else n
            return F.concat(shown, F.lit(separator), x)

        return F.transform(ls, one)

    return unlines(let(lines(t), numbered))


def remove_line_numbers(t: Column) -> Column:
    return rx(t, "(?md)^[ \\t]*[0-9]{1,6}[.):\\x{2013}-]?[ \\t]+")


def affix_lines(t: Column, prefix: str = "", suffix: str = "", skipEmpty: bool = True) -> Column:
    def one(x: Column) -> Column:
        fixed = F.concat(F.lit(prefix), x, F.lit(suffix))
        return F.when(x.rlike(C.NOT_WS), fixed).otherwise(x) if skipEmpty else fixed

    return each_line(t, one)


def _typed(delimiter: str) -> str:
    return delimiter.replace("\\n", "\n").replace("\\t", "\t")


def join_lines(t: Column, separator: str = ", ", quote: str = "", skipEmpty: bool = True) -> Column:
    parts = F.transform(lines(t), trim)
    parts = F.filter(parts, lambda x: x != "") if skipEmpty else parts
    parts = F.transform(parts, lambda x: F.concat(F.lit(quote), x, F.lit(quote))) if quote else parts
    return F.array_join(parts, _typed(separator))


def split_to_lines(t: Column, separator: str = ",", trim: bool = True) -> Column:
    from textloom.functions.core import trim as trimmed

    delimiter = _typed(separator)
    if not delimiter:
        return t
    if not trim:
        return F.replace(t, F.lit(delimiter), F.lit("\n"))
    return unlines(F.transform(F.split(t, literal(delimiter), -1), trimmed))


def reverse(t: Column, mode: str = "lines") -> Column:
    if mode == "lines":
        return unlines(F.reverse(lines(t)))
    if mode == "words":
        return each_line(t, lambda x: F.array_join(F.reverse(F.regexp_extract_all(x, F.lit(f"{C.WS}+|{C.NOT_WS}+"), F.lit(0))), ""))
    return F.reverse(t)

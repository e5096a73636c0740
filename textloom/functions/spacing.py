"""Spaces within lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import CLOSE_QUOTE_POINTS, HS, WS_BODY, body
from textloom.functions.chars import WB as EDGE
from textloom.functions.core import each_line, rx, trim

_CLOSE = body(CLOSE_QUOTE_POINTS)
_TAIL = f"([.!?][{_CLOSE}]?)"
#: Units that get a space before them (fixed values).
UNITS = "kg km cm mm mb gb tb kb hz ml oz lb ft in px pt %"


def collapse_spaces(t: Column) -> Column:
    return rx(t, f"{HS}{{2,}}", " ")


def tabs_to_spaces(t: Column, width: int = 4) -> Column:
    return F.replace(t, F.lit("\t"), F.lit(" " * max(0, width)))


def spaces_to_tabs(t: Column, width: int = 4) -> Column:
    size = max(1, width)

    def one(line: Column) -> Column:
        n = F.length(line) - F.length(F.ltrim(line))
        return F.concat(F.repeat(F.lit("\t"), F.floor(n / size).cast("int")), F.repeat(F.lit(" "), (n % size).cast("int")), F.substr(line, n + 1))

    return each_line(t, one)


def trim_line_ends(t: Column) -> Column:
    return rx(t, f"(?md){HS}+$")


def trim_line_starts(t: Column) -> Column:
    return rx(t, f"(?md)^{HS}+")


def trim_lines(t: Column, end: bool = True, start: bool = True) -> Column:
    t = trim_line_ends(t) if end else t
    return trim_line_starts(t) if start else t


def trim_document(t: Column) -> Column:
    return trim(t)


def space_before_punctuation(t: Column) -> Column:
    t = rx(t, f"{HS}+([,;:!?%\\]}})]|\\.(?!\\.))", "$1")
    return rx(t, f"([(\\[{{]){HS}+", "$1")


def space_after_punctuation(t: Column) -> Column:
    t = rx(t, f"([,;:!?])(?=[^{WS_BODY}0-9\"'{_CLOSE})\\]}}])", "$1 ")
    return rx(t, "([.!?])(?=\\p{Lu})", "$1 ")


def sentence_spacing(t: Column, mode: str = "single") -> Column:
    if mode == "double":
        return rx(t, f"{_TAIL}{HS}+(?=\\p{{Lu}})", "$1  ")
    return rx(t, f"{_TAIL}{HS}{{2,}}", "$1 ")


def space_before_units(t: Column) -> Column:
    return rx(t, f"(?i)([0-9])(?=(?:{'|'.join(UNITS.split())}){EDGE})", "$1 ")

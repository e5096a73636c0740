"""Character repair."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import chars as C
from textloom.functions.core import python, quoted, replace_all, rx


def newlines(t: Column) -> Column:
    return rx(rx(t, "\\r\\n?", "\n"), "[\\x{2028}\\x{2029}]", "\n")


def fix_mojibake(t: Column) -> Column:
    """UTF-8 read as Latin-1 or Windows-1252: whole texts by decoding again, mixed ones by the table; others are left alone."""
    again = F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    table = replace_all(t, C.mojibake_pairs())
    narrow = ~t.rlike("[^\\x{0}-\\x{FF}]")
    fixed = F.when(narrow, F.coalesce(rx(again, "^\\x{FEFF}"), table)).otherwise(table)
    return F.when(t.rlike(C.MOJIBAKE_HINT), fixed).otherwise(t)


def fix_cp1252(t: Column) -> Column:
    high = C.cp1252()
    known = {a: b for a, b in high.items() if a != b}
    unknown = [a for a, b in high.items() if a == b]
    return F.translate(t, "".join(known) + "".join(unknown), "".join(known.values()))


@python
def normalise_unicode(t: Column, form: str = "NFC") -> Column:
    @F.pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    return normal(t)


def remove_invisibles(t: Column) -> Column:
    return rx(t, f"({C.GLUE})|[{C.body(C.INVISIBLE_POINTS)}{C.body(C.TAG_POINTS)}]", "$1")


def remove_bidi(t: Column) -> Column:
    return rx(t, f"[{C.body(C.BIDI_POINTS)}]")


def remove_controls(t: Column, privateUse: bool = True) -> Column:
    points = f"{C.CONTROL_POINTS} {C.OBJECT_POINTS}" + f" {C.PRIVATE_POINTS}" * privateUse
    return rx(t, f"[{C.body(points)}]")


def normalise_spaces(t: Column) -> Column:
    exotic = C.characters(C.EXOTIC_POINTS)
    return F.translate(t, exotic, " " * len(exotic))


def expand_ligatures(t: Column) -> Column:
    return replace_all(t, C.LIGATURES.items())


@F.pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    def plain(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        apart = unicodedata.normalize("NFD", x)
        return unicodedata.normalize("NFC", "".join(c for c in apart if not "\u0300" <= c <= "\u036f"))

    return s.map(plain)


@python
def transliterate(t: Column) -> Column:
    return _unaccented(replace_all(t, C.TRANSLITERATIONS.items()))


def remove_emoji(t: Column) -> Column:
    """Emoji between two words leave a space, others nothing."""
    t = rx(t, f"(?<=[\\p{{L}}\\p{{N}}])(?:{C.EMOJI})+(?=[\\p{{L}}\\p{{N}}])", " ")
    return rx(t, C.EMOJI)


def remove_emoji_and_symbols(t: Column) -> Column:
    return rx(t, C.EMOJI)


def ascii_only(t: Column, replacement: str = "") -> Column:
    """Characters beyond U+FFFF count as two, as their UTF-16 halves do."""
    return rx(rx(t, "[\\x{10000}-\\x{10FFFF}]", quoted(replacement * 2)), "[^\\n\\t -~]", quoted(replacement))

"""Letter case. Texts are cut into pieces that are a word or what stands between words, and each piece is changed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import chars as C
from textloom.functions.core import each_line, first_upper, let, python, rx

#: Words that titles leave in lower case (fixed values).
SMALL_WORDS = "a an and as at but by en for if in is nor of on or per so the to v v. via vs vs. from into over with yet"
_WORD = "\\p{L}[\\p{L}\\p{M}'\\x{2019}]*"
_DOTTED = "\\p{L}[\\p{L}\\p{M}'\\x{2019}.]*"
#: A code point that no text holds, put where a capital is due.
_MARK = chr(0x10FFFF)


def deliberate(word: Column) -> Column:
    """Capitals that were meant: two letters or more, all upper, or an upper after a lower."""
    letters = rx(word, "[^\\p{L}]")
    return (F.length(letters) >= 2) & ((letters == F.upper(letters)) | word.rlike("\\p{Ll}\\p{Lu}"))


def _pieces(t: Column, word: str, change) -> Column:
    parts = F.regexp_extract_all(t, F.lit(f"(?s){word}|\\P{{L}}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\p{L}"), change(p)).otherwise(p)), "")


def sentence(t: Column, preserveAcronyms: bool = True) -> Column:
    lowered = _pieces(t, _DOTTED, lambda w: F.when(deliberate(w), w).otherwise(F.lower(w))) if preserveAcronyms else _pieces(t, _DOTTED, F.lower)
    starts = f"(^|[.!?]{C.WS}+|\\n{C.WS}*|[{C.body(C.OPEN_QUOTE_POINTS)}(]{C.WS}*)(\\p{{Ll}})"
    parts = F.split(rx(lowered, starts, f"$1{_MARK}$2"), _MARK, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def capital(t: Column, preserveAcronyms: bool = True) -> Column:
    return _pieces(t, _WORD, lambda w: F.when(deliberate(w), w).otherwise(first_upper(w)) if preserveAcronyms else first_upper(w))


def title(t: Column, preserveAcronyms: bool = True) -> Column:
    small = F.array(*map(F.lit, SMALL_WORDS.split()))

    def line(x: Column) -> Column:
        def tokens(ts: Column) -> Column:
            solid = lambda p: p.rlike(f"^{C.NOT_WS}")
            places = F.filter(F.transform(ts, lambda p, i: F.when(solid(p), i)), lambda i: i.isNotNull())

            def all_cased(ends: Column) -> Column:
                def cased(p: Column, i: Column) -> Column:
                    bare = F.lower(rx(p, "^[^\\p{L}0-9]+|[^\\p{L}0-9]+\\z"))
                    after = F.coalesce(F.get(ts, i - 2).rlike("[:.;?!-]\\z"), F.lit(False))
                    head = F.regexp_extract(p, "(?s)^\\P{L}*", 0)
                    word = F.regexp_extract(p, f"(?s)^\\P{{L}}*({_WORD})", 1)
                    tail = F.substr(p, F.length(head) + F.length(word) + 1)
                    small_one = F.array_contains(small, bare) & (i != ends["a"]) & (i != ends["b"]) & ~after
                    new = let(word, lambda w: F.when(small_one, F.lower(w)).otherwise(first_upper(w)))
                    new = F.when(deliberate(word), word).otherwise(new) if preserveAcronyms else new
                    return F.concat(head, new, tail)

                return F.array_join(F.transform(ts, lambda p, i: F.when(solid(p), cased(p, i)).otherwise(p)), "")

            return let(F.struct(F.array_min(places).alias("a"), F.array_max(places).alias("b")), all_cased)

        return let(F.regexp_extract_all(x, F.lit(f"{C.NOT_WS}+|{C.WS}+"), F.lit(0)), tokens)

    return each_line(t, line)


def _letters(t: Column, change) -> Column:
    """Pieces that end in their only letter; the n-th letter is changed by ``change(letter, n)``."""
    parts = F.regexp_extract_all(t, F.lit("(?s)\\P{L}*\\p{L}|\\P{L}+"), F.lit(0))

    def one(p: Column, i: Column) -> Column:
        last = F.substr(p, F.length(p))
        return F.when(p.rlike("\\p{L}\\z"), F.concat(F.substr(p, F.lit(1), F.length(p) - 1), change(last, i))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def toggle(t: Column) -> Column:
    return _letters(t, lambda c, i: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c)))


def alternating(t: Column) -> Column:
    return _letters(t, lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c)))


def words(t: Column) -> Column:
    apart = rx(t, "([\\p{Ll}0-9])(\\p{Lu})", "$1 $2")
    return F.filter(F.split(apart, "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")


def camel(t: Column) -> Column:
    return F.array_join(F.transform(words(t), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(first_upper(w))), "")


def pascal(t: Column) -> Column:
    return F.array_join(F.transform(words(t), first_upper), "")


def joined(t: Column, by: str, change=F.lower) -> Column:
    return F.array_join(F.transform(words(t), change), by)


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    low, high = chr(0x300), chr(0x36F)
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if not low <= c <= high))


@python
def slug(t: Column) -> Column:
    return rx(rx(F.lower(_bare(t)), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+\\z")


MODES = {
    "sentence": sentence,
    "title": title,
    "capital": capital,
    "upper": lambda t: F.upper(t),
    "lower": lambda t: F.lower(t),
    "toggle": toggle,
    "alternating": alternating,
    "camel": camel,
    "pascal": pascal,
    "snake": lambda t: joined(t, "_"),
    "kebab": lambda t: joined(t, "-"),
    "constant": lambda t: joined(t, "_", F.upper),
    "dot": lambda t: joined(t, "."),
    "slug": slug,
}


@python(when=lambda params: params.get("mode") == "slug")
def change_case(t: Column, mode: str = "sentence", preserveAcronyms: bool = True) -> Column:
    """Unknown modes are sentence case."""
    if mode not in MODES or mode in ("sentence", "title", "capital"):
        return MODES.get(mode, sentence)(t, preserveAcronyms)
    return MODES[mode](t)

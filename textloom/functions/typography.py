"""Quotes, dashes, symbols, links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import chars as C
from textloom.functions.core import python, replace_all, rx

#: Query keys that only track (fixed values; matched whole, in any case).
TRACKING = (
    r"utm_\w+ fbclid gclid gbraid wbraid dclid mc_[ce]id _hs\w* igshid ref ref_src ref_url si spm yclid msclkid ttclid trk "
    r"trkCampaign cmpid campaign_id s_kwcid vero_\w+ oly_\w+ hsa_\w+ __s _ga scid"
)


def straighten_quotes(t: Column) -> Column:
    single, double = C.characters(C.SINGLE_QUOTES), C.characters(C.DOUBLE_QUOTES)
    return F.translate(t, single + double, "'" * len(single) + '"' * len(double))


def curl_quotes(t: Column) -> Column:
    t = rx(t, "(\\w)'(\\w)", "$1\u2019$2")
    t = rx(t, "'(?=[0-9][0-9])", "\u2019")
    t = rx(t, f"(?i)'(?=(?:tis|twas|til|em|cause|n'){C.WB})", "\u2019")
    t = rx(t, f'(?md)(^|[{C.WS_BODY}(\\[{{-])"', "$1\u201c")
    t = rx(t, f"(?md)(^|[{C.WS_BODY}(\\[{{-])'", "$1\u2018")
    return F.translate(t, "\"'", "\u201d\u2019")


def straighten_dashes(t: Column) -> Column:
    dashes = C.characters(C.DASHES)
    spaced = rx(t, f"({C.NOT_WS})[\\x{{2014}}\\x{{2015}}]({C.NOT_WS})", "$1 - $2")
    return F.translate(spaced, dashes, "-" * len(dashes))


def typographic_dashes(t: Column) -> Column:
    t = rx(t, f"([0-9]){C.WS}*-{C.WS}*([0-9])", "$1\u2013$2")
    return F.replace(rx(t, f"{C.WS}+--{C.WS}+", "\u2014"), F.lit("..."), F.lit("\u2026"))


def ascii_symbols(t: Column) -> Column:
    return replace_all(t, C.SYMBOLS.items())


_URL = re.compile(r"(?<![A-Za-z0-9_])https?://[^" + "".join(re.escape(c) for c in C.characters(C.SPACE_POINTS)) + r"<>\"'\])]+", re.I)
_TRACKS = re.compile("(?:" + "|".join(TRACKING.split()) + r")\Z", re.I | re.A)


def without_tracking(url: str) -> str:
    """The link without query pairs whose key only tracks, or that are empty."""
    head, mark, fragment = url.partition("#")
    base, asked, query = head.partition("?")
    if not asked:
        return url
    pairs = [p for p in query.split("&") if p and not _TRACKS.match(p.partition("=")[0])]
    return base + "?" * bool(pairs) + "&".join(pairs) + mark + fragment


@F.pandas_udf(StringType())
def _clean_urls(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or "?" not in x else _URL.sub(lambda m: without_tracking(m[0]), x))


@python
def clean_urls(t: Column, removeTracking: bool = True, unshorten: bool = False) -> Column:
    """In free text; ``unshorten`` changes nothing, as no network is used."""
    return _clean_urls(t) if removeTracking else t


def clean_url_column(url: Column) -> Column:
    """For a column that holds one link a row: no Python."""
    head = F.substring_index(url, "#", 1)
    fragment = F.substr(url, F.length(head) + 1)
    base = F.substring_index(head, "?", 1)
    query = F.substr(head, F.length(base) + 2)
    tracks = "(?i)^(?:" + "|".join(TRACKING.split()) + ")\\z"
    pairs = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(tracks))
    cleaned = F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), fragment)
    return F.when(F.contains(head, F.lit("?")), cleaned).otherwise(url)

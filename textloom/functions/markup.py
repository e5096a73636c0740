"""HTML, Markdown and entities.

Most of it is column expressions; Python (Arrow batches) is only used where a match's inside has to be rewritten.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import chars as C
from textloom.functions.core import let, python, quoted, replace_all, rx, trim

#: Tags that stand for a paragraph break, a line break, and tags that mark a text as HTML (fixed values).
BLOCK_TAGS = (
    "address article aside blockquote div dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table tbody tfoot thead ul"
)
LINE_TAGS = "br tr"
HTML_TAGS = "p div span br a ul ol li table tr td h[1-6] strong em b i img body html font o:p"
HIDDEN_TAGS = "script style noscript head title svg math"
ENTITY = "&(?:#x?[0-9a-f]+|[a-z][a-z0-9]{1,31});"
#: The end of a tag's name, for ASCII names.
_END = "(?![A-Za-z0-9_])"


def looks_like_html(t: Column) -> Column:
    return t.rlike(f"(?i)<(?:{'|'.join(HTML_TAGS.split())}){_END}[^>]*>")


def _numeric(body: Column) -> Column:
    """The character of ``#123`` or ``#x7B``; null if there is none."""
    is_hex = body.rlike("^#[xX]")
    digits = F.when(is_hex, F.substr(body, F.lit(3))).otherwise(F.regexp_extract(body, "^#([0-9]+)", 1))
    # up to 7 significant digits cover all of Unicode; more are out of range
    short = rx(digits, "^0+(?=.)")
    point = F.when((short != "") & (F.length(short) <= 7), F.conv(short, 16, 10).cast("int")).otherwise(None)
    decimal = F.when((short != "") & (F.length(short) <= 7), short.cast("int")).otherwise(None)
    cp = F.when(is_hex, point).otherwise(decimal)
    cp = F.when((cp >= 0xD800) & (cp <= 0xDFFF), 0xFFFD).otherwise(cp)
    high = C.cp1252()

    def character(cp: Column) -> Column:
        c = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
        return F.when((cp >= 0) & (cp <= 0x10FFFF), F.translate(c, "".join(high), "".join(high.values())))

    return let(cp, character)


def decode_entities(t: Column) -> Column:
    """One pass: the result of an entity is not read again. Unknown ones stay; lone surrogates become U+FFFD."""
    named = C.NAMED_ENTITIES
    lowered: dict[str, str] = {}
    for name, value in named.items():
        lowered.setdefault(name.lower(), value)
    exact, lower = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (named, lowered))

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(2), F.length(p) - 2)
        plain = F.coalesce(F.try_element_at(exact, body), F.try_element_at(lower, F.lower(body)), p)
        return F.when(F.length(p) < 3, p).when(p.rlike("^&#.*;\\z"), F.coalesce(_numeric(body), p)).when(p.rlike("(?s)^&.*;\\z"), plain).otherwise(p)

    parts = F.regexp_extract_all(t, F.lit(f"(?is){ENTITY}|&|[^&]+"), F.lit(0))
    return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(t)


def encode_entities(t: Column, all: bool = False) -> Column:  # noqa: A002
    """With ``all``, characters beyond ASCII too, by UTF-16 unit."""
    base = replace_all(t, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])
    if not all:
        return base

    def unit(n: Column) -> Column:
        return F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))

    def one(c: Column) -> Column:
        cp = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
        wide = F.concat(unit(F.floor((cp - 0x10000) / 0x400) + 0xD800), unit((cp - 0x10000) % 0x400 + 0xDC00))
        return F.when(c.rlike("[\\n\\t -~]"), c).when(cp > 0xFFFF, wide).otherwise(unit(cp))

    escaped = F.array_join(F.transform(F.split(base, ""), one), "")
    return F.when(base.rlike("[^\\n\\t -~]"), escaped).otherwise(base)


_ANCHOR = re.compile(r"""<a(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])href\s*=\s*(["'])(.*?)\1[^>]*>([\s\S]*?)</a>""", re.I)
_TAG = re.compile(r"<[^>]*>")
_JS_SPACE = C.characters(C.SPACE_POINTS)


def _link_text(m: re.Match) -> str:
    label, href = _TAG.sub("", m[3]).strip(_JS_SPACE), m[2]
    if not href or href[0] == "#" or href[:11].lower() == "javascript:":
        return label
    return f"{label} ({href})" if label and label != href else href


@F.pandas_udf(StringType())
def _links_spelled(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else _ANCHOR.sub(_link_text, x))


def _without_islands(t: Column) -> Column:
    t = rx(t, "(?is)<!--\\[if.*?<!\\[endif\\]-->")
    t = rx(t, "(?is)<\\?xml.*?\\?>")
    t = rx(t, f"(?is)<xml{_END}.*?</xml>")
    t = rx(t, "(?s)<!--.*?-->")
    t = rx(t, "(?i)<!doctype[^>]*>")
    return rx(t, f"(?is)<({'|'.join(HIDDEN_TAGS.split())}){_END}[^>]*>.*?</\\1>")


def _tidied(t: Column) -> Column:
    t = rx(rx(t, f"{C.HS}+", " "), " *\\n *", "\n")
    return trim(rx(t, "\\n{3,}", "\n\n"))


@python(when=lambda params: bool(params.get("keepLinks")))
def html_to_text(t: Column, keepLinks: bool = False, listMarker: str = "- ", keepStructure: bool = True) -> Column:
    """Text with blocks as line breaks; a null stays null."""
    t = _without_islands(t)
    t = _links_spelled(t) if keepLinks else t
    # a name ends where neither a letter, digit or underscore nor hyphens and more of a name follow
    tag = lambda names: f"(?i)</?(?:{'|'.join(names.split())})(?!-*[a-z0-9])(?!_)[^>]*>"
    any_tag = f"(?i)</?[a-z][a-z0-9-]*(?::[a-z0-9-]+)?{C.WB}[^>]*>"
    if not keepStructure:
        return trim(rx(decode_entities(rx(t, any_tag, " ")), f"{C.WS}+", " "))
    t = rx(t, f"(?i)<li{_END}[^>]*>", "\n" + quoted(listMarker))
    t = rx(t, f"(?i)</(?:td|th)>{C.WS}*(?=<(?:td|th){_END})", "\t")
    t = rx(t, f"(?i)<hr{_END}[^>]*>", "\n\n---\n\n")
    t = rx(t, tag(LINE_TAGS), "\n")
    t = rx(t, tag(BLOCK_TAGS), "\n\n")
    t = decode_entities(rx(t, any_tag))
    return _tidied(rx(t, "\\r\\n?", "\n"))


def strip_tags(t: Column, decode: bool = True) -> Column:
    t = rx(t, "(?s)<!--.*?-->")
    t = rx(t, f"(?is)<(script|style){_END}[^>]*>.*?</\\1>")
    t = rx(t, "<[^>]*>")
    return decode_entities(t) if decode else t


_WS = "[" + "".join(re.escape(c) for c in _JS_SPACE) + "]"
_SOLID = "[^" + "".join(re.escape(c) for c in _JS_SPACE) + "]"
_FENCE = re.compile(r"^```[\s\S]*?^```$", re.M)
_ROW = re.compile(rf"^{_WS}{{0,3}}\|.*\|{_WS}*$", re.M)
_RULE_ROW = re.compile(rf"{_WS}*\|[{_WS[1:-1]}:|\-]+\|{_WS}*")
#: What Markdown marks up, in the order in which it is taken away.
_MARKS = [
    (re.compile(r"`{1,3}([^`]+)`{1,3}"), r"\1"),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]+)\]\[[^\]]*\]"), r"\1"),
    (re.compile(rf"^{_WS}{{0,3}}#{{1,6}}{_WS}+", re.M), ""),
    (re.compile(rf"^{_WS}{{0,3}}>{_WS}?", re.M), ""),
    (re.compile(rf"^{_WS}{{0,3}}(?:[-*_]{_WS}*){{3,}}$", re.M), ""),
    *((re.compile(rf"({mark})({_SOLID}[\s\S]*?{_SOLID})\1"), r"\2") for mark in (r"\*\*\*|___", r"\*\*|__", r"\*|_")),
    (re.compile(rf"~~({_SOLID}[\s\S]*?{_SOLID})~~"), r"\1"),
]
_TAIL_MARKS = [(re.compile(rf"^{_WS}{{0,3}}[-*+]{_WS}+", re.M), ""), (re.compile(r"\\([\\`*_{}\[\]()#+\-.!])"), r"\1")]


def _table_row(m: re.Match) -> str:
    if _RULE_ROW.fullmatch(m[0]):
        return ""
    row = m[0].strip(_JS_SPACE)
    return "\t".join(cell.strip(_JS_SPACE) for cell in row.removeprefix("|").removesuffix("|").split("|"))


def plain_markdown(x: str) -> str:
    x = _FENCE.sub(lambda m: "\n".join(m[0].split("\n")[1:-1]), x)
    for pattern, to in _MARKS:
        x = pattern.sub(to, x)
    x = _ROW.sub(_table_row, x)
    for pattern, to in _TAIL_MARKS:
        x = pattern.sub(to, x)
    return x


@F.pandas_udf(StringType())
def _plain_markdown(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else plain_markdown(x))


@python
def strip_markdown(t: Column) -> Column:
    return _plain_markdown(t)


def _html(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("@", r"(?![A-Za-z0-9_])[^>]*>"), re.I)


def _inside(x: str) -> str:
    return _TAG.sub("", x).strip(_JS_SPACE)


#: HTML as Markdown, in order.
_TO_MARKDOWN = [
    (re.compile(r"<!--[\s\S]*?-->"), ""),
    (_html(r"<(script|style|noscript|head)@[\s\S]*?</\1>"), ""),
    (_html(r"<h([1-6])@([\s\S]*?)</h\1>"), lambda m: f"\n\n{'#' * int(m[1])} {_inside(m[2])}\n\n"),
    (_html(r"<(?:strong|b)@([\s\S]*?)</(?:strong|b)>"), r"**\1**"),
    (_html(r"<(?:em|i)@([\s\S]*?)</(?:em|i)>"), r"_\1_"),
    (_html(r"<code@([\s\S]*?)</code>"), r"`\1`"),
    (_ANCHOR, lambda m: f"[{_inside(m[3])}]({m[2]})"),
    (re.compile(r"""<img(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])src\s*=\s*(["'])(.*?)\1[^>]*>""", re.I), r"![](\2)"),
    (_html(r"<blockquote@([\s\S]*?)</blockquote>"), lambda m: "\n\n" + "\n".join("> " + x for x in _inside(m[1]).split("\n")) + "\n\n"),
    (_html(r"<li@"), "\n- "),
    (_html(r"<hr@"), "\n\n---\n\n"),
    (_html(r"<br@"), "  \n"),
    (re.compile(r"</(?:p|div|ul|ol|table|tr|section|article)>", re.I), "\n\n"),
    (_TAG, ""),
]


@F.pandas_udf(StringType())
def _as_markdown(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        for pattern, to in _TO_MARKDOWN if x else ():
            x = pattern.sub(to, x)
        return x

    return s.map(one)


@python
def html_to_markdown(t: Column) -> Column:
    return _tidied(decode_entities(_as_markdown(t)))

"""Named queries over the test tables, each with SQL for DuckDB where SQL can say the same.

The tables hold clean prose, so most queries first put the same flaws into it on both sides by literal replacement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chars as C
from textloom.functions import linewise, repair, replace, spacing, typography
from textloom.functions.core import replace_all
from textloom.operators import relational, scan, stats
from textloom.operators.registry import OPS
from textloom.plans import cleaner
from textloom.plans.pipeline import apply_op, run_pipeline

# ---------------------------------------------------------------------------------------------------------------------
# Flaws

DIRT = [
    (", ", " , "), (" the ", "\xa0the "), (" de ", "  de "), ("tion", "ti\xadon"), (" and ", " \u201cand\u201d "), (" of ", "\u2014"),
    (" und ", " \u2013 und "), (" que ", " que\u200b "), ("fi", "\ufb01"), (" in ", " in\U0001f600 "), (".\n", ". \n\n\n"),
    (" die ", " die\x92s "), (" la ", " l\xe2\u20ac\u2122a "), (" to ", "\tto\n\u2022 "), (" is ", " &amp;is "), (" ou ", " ou\x07 "),
    (" der ", "\r\n> der "),
]
LINES = [
    (". ", ".\n 12 \n"), (" and ", "\nand\n"), (" is ", "\n\n\nis "), (" to ", "\n- to "), (" de ", "\n3) de "), (" und ", "-\nund "),
    (" of ", "\n\tOf\n"), (" in ", "\n    in "), (" que ", "\n> que "),
]
APART = [("\xe9", "e\u0301"), ("\xfc", "u\u0308"), ("\xf1", "n\u0303")]
QUOTES = [(" the ", ' "the" '), (" and ", " 'and' "), (" of ", " it's "), (" is ", " '90 "), (" de ", " 1 - 2 -- ... ")]
MARKS = [(" the ", " \u2122\xa9 "), (" and ", " \u2026 "), (" de ", " \xbd "), (" of ", " 5\xb0 \u2192 ")]
TIGHT = [(", ", ","), (". ", ".")]
LINKS = [(" the ", " https://a.org/x?utm_source=b&q=1#top "), (" de ", " http://b.org/?fbclid=1 "), (" and ", " www.c.org/d ")]
ESCAPES = [(" the ", "\\u00e9"), (" and ", '\\"')]


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_replace(t: str, pairs) -> str:
    for a, b in pairs:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def sql_rx(t: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def sql_trim(t: str) -> str:
    return sql_rx(t, f"^{C.WS}+|{C.WS}+$")


def sql_lines(t: str) -> str:
    return f"string_split({t}, chr(10))"


def sql_join(a: str, by: str = "\n") -> str:
    return f"array_to_string({a}, {q(by)})"


def sql_each(t: str, body: str) -> str:
    """``body`` of each line x."""
    return sql_join(f"list_transform({sql_lines(t)}, lambda x: {body})")


def sql_keep(t: str, condition: str) -> str:
    return sql_join(f"list_filter({sql_lines(t)}, lambda x: {condition})")


def sql_translate(t: str, a: str, b: str) -> str:
    return f"translate({t}, {q(a)}, {q(b)})"


NEWLINES = sql_rx(sql_rx("t", "\\r\\n?", "\n"), "[\\x{2028}\\x{2029}]", "\n")


def fill(template: str, **values: str) -> str:
    """``{name}`` by value; other braces belong to patterns."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template


def steps(source: str, exprs: list[str], select: str = "doc_id, t AS text", key: str = "doc_id") -> str:
    """``source`` gives (key, t); each expression in t is a step of its own."""
    ctes = [f"s0 AS ({source})"]
    for i, e in enumerate(exprs):
        ctes.append(f"s{i + 1} AS (SELECT {key}, {e} AS t FROM s{i})")
    return f"WITH {', '.join(ctes)} SELECT {select} FROM s{len(exprs)}"


def source_sql(dirt, table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"SELECT {key}, {sql_replace(column, dirt)} AS t FROM {table}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty(spark: SparkSession, sf: str, dirt, name: str = "documents", key: str = "doc_id", column: str = "text") -> DataFrame:
    return table(spark, sf, name).select(key, replace_all(F.col(column), dirt).alias("text"))


# ---------------------------------------------------------------------------------------------------------------------
# SQL of the operations, as steps in t

_MARK, _CLOSE, _OPEN = C.body(C.MARKER_POINTS), C.body(C.CLOSE_QUOTE_POINTS), C.body(C.OPEN_QUOTE_POINTS)
_NUMBER = "(?:\\(?[0-9]{1,3}[.)\\]]|\\(?[a-zA-Z][.)\\]]|[ivxlcIVXLC]{1,5}[.)])"
_DIGITS = f"{C.WS}*[0-9]{{1,4}}{C.WS}*"
PAGE = (
    f"^{_DIGITS}$|^{C.WS}*[-\\x{{2013}}\\x{{2014}}\\[(]?{_DIGITS}[-\\x{{2013}}\\x{{2014}}\\])]?{C.WS}*$"
    f"|^(?i:{C.WS}*page{C.WS}+[0-9]{{1,4}}({C.WS}+of{C.WS}+[0-9]{{1,4}})?{C.WS}*)$|^{_DIGITS}[|/]{_DIGITS}$|^(?i:{C.WS}*[ivxlcdm]{{1,7}}{C.WS}*)$"
)
_HIGH = C.cp1252()
_KNOWN = {a: b for a, b in _HIGH.items() if a != b}
BLANK = f"NOT regexp_matches(x, {q(C.NOT_WS)})"
WORDS = f"list_filter(string_split_regex({sql_rx('t', '([\\p{Ll}0-9])(\\p{Lu})', '\\1 \\2')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_upper(x: str) -> str:
    return f"upper(replace({x}, chr(223), 'SS'))"


def sql_first(w: str) -> str:
    return f"({sql_upper(f'{w}[1]')} || lower({w}[2:]))"


def sql_gated_mojibake() -> str:
    table_path = sql_replace("t", C.mojibake_pairs())
    return f"CASE WHEN regexp_matches(t, {q(C.MOJIBAKE_HINT)}) THEN {table_path} ELSE t END"


def sql_before_punctuation() -> list[str]:
    return [
        sql_rx("t", f"{C.HS}+([,;:!?%\\]}})])", "\\1"),
        sql_rx("t", f"{C.HS}+\\.([^.]|$)", ".\\1"),
        sql_rx("t", f"([(\\[{{]){C.HS}+", "\\1"),
    ]


def sql_extract(pattern: str) -> str:
    found = f"list_transform(regexp_extract_all(t, {q(pattern)}), lambda x: {sql_trim('x')})"
    return f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), chr(10))"


_QUOTED = [
    ("(\\w)'(\\w)", "\\1\u2019\\2"), ("'([0-9][0-9])", "\u2019\\1"), ("(?i)'((?:tis|twas|til|em|cause|n')\\b)", "\u2019\\1"),
    (f'(?m)(^|[{C.WS_BODY}(\\[{{-])"', "\\1\u201c"), (f"(?m)(^|[{C.WS_BODY}(\\[{{-])'", "\\1\u2018"), ('"', "\u201d"), ("'", "\u2019"),
]
_SAFE_PUNCT = ("\ue001\ue002\ue003", ".,'")
#: id -> (dirt, parameters, steps).
SQL_OPS: dict[str, tuple] = {
    "decodeEntities": (DIRT, {}, [sql_replace("t", [("&amp;", "&")])]),
    "encodeEntities": (DIRT, {}, [sql_replace("t", [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])]),
    "fixMojibake": (DIRT, {}, [sql_gated_mojibake()]),
    "fixCp1252": (DIRT, {}, [sql_translate("t", "".join(_KNOWN) + "".join(a for a in _HIGH if a not in _KNOWN), "".join(_KNOWN.values()))]),
    "normaliseUnicode": (APART, {}, ["nfc_normalize(t)"]),
    "removeInvisibles": (DIRT, {}, [sql_rx("t", f"[{C.body(C.INVISIBLE_POINTS)}{C.body(C.TAG_POINTS)}]")]),
    "removeControls": (DIRT, {}, [sql_rx("t", f"[{C.body(C.CONTROL_POINTS)}{C.body(C.OBJECT_POINTS)}{C.body(C.PRIVATE_POINTS)}]")]),
    "normaliseSpaces": (DIRT, {}, [sql_rx("t", f"[{C.body(C.EXOTIC_POINTS)}]", " ")]),
    "expandLigatures": (DIRT, {}, [sql_replace("t", C.LIGATURES.items())]),
    "transliterate": (MARKS, {}, [sql_replace("t", C.TRANSLITERATIONS.items()), sql_rx("strip_accents(t)", f"[{C.body(C.COMBINING_POINTS)}]")]),
    "removeEmoji": (DIRT, {}, ["replace(t, chr(128512), '')"]),
    "asciiOnly": (DIRT, {"replacement": "?"}, [sql_rx("t", "[\\x{10000}-\\x{10FFFF}]", "??"), sql_rx("t", "[^\\n\\t -~]", "?")]),
    "straightenQuotes": (DIRT, {}, [sql_translate("t", C.characters(C.SINGLE_QUOTES) + C.characters(C.DOUBLE_QUOTES), "'" * 11 + '"' * 10)]),
    "curlQuotes": (QUOTES, {}, [sql_rx("t", a, b) for a, b in _QUOTED]),
    "straightenDashes": (DIRT, {}, [sql_rx("t", f"({C.NOT_WS})[\\x{{2014}}\\x{{2015}}]({C.NOT_WS})", "\\1 - \\2"), sql_translate("t", C.characters(C.DASHES), "-" * 11)]),
    "typographicDashes": (QUOTES, {}, [sql_rx("t", f"([0-9]){C.WS}*-{C.WS}*([0-9])", "\\1\u2013\\2"), sql_rx("t", f"{C.WS}+--{C.WS}+", "\u2014"), "replace(t, '...', chr(8230))"]),
    "asciiSymbols": (MARKS, {}, [sql_replace("t", C.SYMBOLS.items())]),
    "cleanUrls": (LINKS, {}, [sql_replace("t", [("https://a.org/x?utm_source=b&q=1#top", "https://a.org/x?q=1#top"), ("http://b.org/?fbclid=1", "http://b.org/")])]),
    "removeEmailQuoting": (LINES, {}, [sql_rx("t", "(?m)^[ \\t]*(?:>[ \\t]?)+")]),
    "removeListMarkers": (LINES, {}, [sql_rx("t", f"(?m)^([ \\t]*)[{_MARK}][ \\t]+", "\\1"), sql_rx("t", f"(?m)^([ \\t]*){_NUMBER}[ \\t]+", "\\1")]),
    "normaliseListMarkers": (LINES, {"marker": "* "}, [sql_rx("t", f"(?m)^([ \\t]*)[{_MARK}][ \\t]+", "\\1* ")]),
    "removePageNumbers": (LINES, {}, [sql_keep("t", f"NOT regexp_matches(x, {q(PAGE)})")]),
    "dehyphenate": (LINES, {}, [sql_rx("t", f"(\\p{{Ll}})[-\\x{{AD}}]\\n{C.HS}*(\\p{{Ll}})", "\\1\\2")]),
    "removeAllLineBreaks": (LINES, {}, [sql_join(f"list_filter(list_transform({sql_lines('t')}, lambda x: {sql_trim('x')}), lambda x: x <> '')", " ")]),
    "removeEmptyLines": (LINES, {}, [sql_keep("t", f"NOT ({BLANK})")]),
    "collapseBlankLines": (LINES, {}, [sql_rx("t", "\\n{2,}", "\n\n")]),
    "doubleSpaceLines": (LINES, {}, ["replace(t, chr(10), chr(10) || chr(10))"]),
    "filterLines": (LINES, {"pattern": "THE", "mode": "drop"}, [sql_keep("t", "NOT contains(lower(x), 'the')")]),
    "sortLines": (LINES, {"ignoreCase": False}, [sql_join(f"list_sort({sql_lines('t')})")]),
    "sortLines_desc": (LINES, {"order": "desc", "ignoreCase": False}, [sql_join(f"list_reverse_sort({sql_lines('t')})")]),
    "sortLines_reverse": (LINES, {"order": "reverse"}, [sql_join(f"list_reverse({sql_lines('t')})")]),
    "tabsToSpaces": (DIRT, {}, ["replace(t, chr(9), '    ')"]),
    "spacesToTabs": (LINES, {"width": 3}, [sql_each("t", "repeat(chr(9), (len(x) - len(ltrim(x, ' '))) // 3) || repeat(' ', (len(x) - len(ltrim(x, ' '))) % 3) || ltrim(x, ' ')")]),
    "collapseSpaces": (DIRT, {}, [sql_rx("t", f"{C.HS}{{2,}}", " ")]),
    "trimLines": (DIRT, {}, [sql_rx("t", f"(?m){C.HS}+$"), sql_rx("t", f"(?m)^{C.HS}+")]),
    "fixSpaceBeforePunctuation": (DIRT, {}, sql_before_punctuation()),
    "fixSpaceAfterPunctuation": (TIGHT, {}, [sql_rx("t", f"([,;:!?])([^{C.WS_BODY}0-9\"'{_CLOSE})\\]}}])", "\\1 \\2")] * 2 + [sql_rx("t", "([.!?])(\\p{Lu})", "\\1 \\2")]),
    "sentenceSpacing": ([(". ", ".   ")], {}, [sql_rx("t", f"([.!?][{_CLOSE}]?){C.HS}{{2,}}", "\\1 ")]),
    "sentenceSpacing_double": ([(". ", ".   ")], {"mode": "double"}, [sql_rx("t", f"([.!?][{_CLOSE}]?){C.HS}+(\\p{{Lu}})", "\\1  \\2")]),
    "findReplace": ([], {"rules": [{"find": "the", "replace": "$5"}, {"find": "tion", "replace": "sion"}], "wholeWord": True}, [sql_rx("t", "(?i)\\bthe\\b", "$5"), sql_rx("t", "(?i)\\btion\\b", "sion")]),
    "findReplace_regex": ([], {"rules": [{"find": "(\\w+)tion\\b", "replace": "<$1|$&>\\n"}], "regex": True, "matchCase": True}, [sql_rx("t", "(\\w+)tion\\b", "<\\1|\\0>\n")]),
    "removeCharacters": ([], {"characters": "a-cX.*"}, [sql_rx("t", "[a-cX.*]")]),
    "removePunctuation": ([], {}, [sql_translate("t", _SAFE_PUNCT[1], _SAFE_PUNCT[0]), sql_rx("t", "[\\p{P}\\p{S}]"), sql_translate("t", *_SAFE_PUNCT)]),
    "removeNumbers": ([], {}, [sql_rx("t", "[0-9]")]),
    "extract": (LINKS, {}, [sql_extract(f"(?i)\\bhttps?://[^{C.WS_BODY}<>\"')\\]]+|\\bwww\\.[^{C.WS_BODY}<>\"')\\]]+")]),
    "extract_emails": ([], {"pattern": "emails"}, [sql_extract("[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\w")]),
    "extract_numbers": ([], {"pattern": "numbers"}, [sql_extract("-?[0-9][0-9,]*(?:\\.[0-9]+)?")]),
    "extract_hashtags": ([(" the ", " #the_1 ")], {"pattern": "hashtags"}, [sql_extract("#[\\p{L}0-9_]+")]),
    "extract_mentions": ([], {"pattern": "mentions"}, [sql_extract("@[\\w.]+")]),
    "extract_ips": ([], {"pattern": "ips"}, [sql_extract("\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b")]),
    "extract_dates": ([(" the ", " 2024-01-31 ")], {"pattern": "dates"}, [sql_extract("\\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\\b")]),
    "extract_phones": ([], {"pattern": "phones"}, [sql_extract(f"\\+?[0-9][0-9{C.WS_BODY}().-]{{7,}}[0-9]")]),
    "changeCase_upper": ([], {"mode": "upper"}, [sql_upper("t")]),
    "changeCase_lower": ([], {"mode": "lower"}, ["lower(t)"]),
    "changeCase_toggle": ([], {"mode": "toggle"}, [f"array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN lower(c) = c THEN {sql_upper('c')} ELSE lower(c) END), '')"]),
    "changeCase_alternating": ([], {"mode": "alternating"}, [f"array_to_string(list_transform(regexp_extract_all(t, '(?s)\\P{{L}}*\\p{{L}}|\\P{{L}}+'), lambda x, i: CASE WHEN i % 2 = 1 THEN {sql_upper('x')} ELSE lower(x) END), '')"]),
    "changeCase_camel": ([], {"mode": "camel"}, [f"array_to_string(list_transform({WORDS}, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE {sql_first('w')} END), '')"]),
    "changeCase_pascal": ([], {"mode": "pascal"}, [f"array_to_string(list_transform({WORDS}, lambda w: {sql_first('w')}), '')"]),
    "changeCase_snake": ([], {"mode": "snake"}, [f"lower(array_to_string({WORDS}, '_'))"]),
    "changeCase_kebab": ([], {"mode": "kebab"}, [f"lower(array_to_string({WORDS}, '-'))"]),
    "changeCase_constant": ([], {"mode": "constant"}, [sql_upper(f"array_to_string({WORDS}, '_')")]),
    "changeCase_dot": ([], {"mode": "dot"}, [f"lower(array_to_string({WORDS}, '.'))"]),
    "changeCase_slug": ([], {"mode": "slug"}, ["lower(strip_accents(t))", sql_rx("t", "[^\\p{L}\\p{N}]+", "-"), sql_rx("t", "^-+|-+$")]),
    "affixLines": (LINES, {"prefix": "<", "suffix": ">"}, [sql_each("t", f"CASE WHEN {BLANK} THEN x ELSE '<' || x || '>' END")]),
    "numberLines": (LINES, {"pad": True}, [f"array_to_string(list_transform({sql_lines('t')}, lambda x, i: lpad(i::VARCHAR, len(len({sql_lines('t')})::VARCHAR)::INT, ' ') || '. ' || x), chr(10))"]),
    "removeLineNumbers": (LINES, {}, [sql_rx("t", "(?m)^[ \\t]*[0-9]{1,6}[.):\\x{2013}-]?[ \\t]+")]),
    "joinLines": (LINES, {"quote": "'"}, [sql_join(f"list_transform(list_filter(list_transform({sql_lines('t')}, lambda x: {sql_trim('x')}), lambda x: x <> ''), lambda x: '''' || x || '''')", ", ")]),
    "splitToLines": ([], {}, [f"array_to_string(list_transform(string_split(t, ','), lambda x: {sql_trim('x')}), chr(10))"]),
    "reverse": (LINES, {}, [sql_join(f"list_reverse({sql_lines('t')})")]),
    "reverse_words": (LINES, {"mode": "words"}, [sql_each("t", f"array_to_string(list_reverse(regexp_extract_all(x, {q(f'{C.WS}+|{C.NOT_WS}+')})), '')")]),
    "reverse_characters": ([], {"mode": "characters"}, ["reverse(t)"]),
    "encode": ([], {}, [sql_replace("url_encode(t)", [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")])]),
    "encode_urlDecode": ([("%", ""), (" ", "%20"), ("\xe9", "%C3%A9")], {"mode": "urlDecode"}, [sql_replace("t", [("%20", " "), ("%C3%A9", "\xe9"), ("+", " ")])]),
    "encode_base64Encode": ([], {"mode": "base64Encode"}, ["base64(encode(t))"]),
    "encode_jsonEscape": ([(" the ", ' "the\\ ')], {"mode": "jsonEscape"}, ["(to_json(t)::VARCHAR)[2:-2]"]),
    "encode_jsonUnescape": (ESCAPES, {"mode": "jsonUnescape"}, [sql_replace("t", [("\\u00e9", "\xe9"), ('\\"', '"')])]),
    "encode_csv": ([], {"mode": "csv"}, ["'\"' || replace(replace(t, '\"', '\"\"'), chr(10), ' ') || '\"'"]),
    "trimDocument": ([(" the ", " the\n")], {}, [sql_trim("t")]),
}
#: Without SQL: id -> (dirt, parameters); held by tests against plain Python.
PLAIN_OPS: dict[str, tuple] = {
    "stripMarkdown": ([(" the ", " **the** "), (" de ", "\n# de "), (" of ", " [of](x) ")], {}),
    "unwrapParagraphs": (LINES, {}),
    "sortLines_natural": (LINES, {"order": "asc"}),
    "sortLines_length": (LINES, {"order": "length"}),
    "sortLines_lengthDesc": (LINES, {"order": "lengthDesc"}),
    "changeCase": ([], {"mode": "sentence"}),
    "changeCase_title": ([], {"mode": "title"}),
    "wrapLines": ([], {"width": 60}),
}


def _op_query(name: str, dirt, params: dict) -> Callable:
    op_id = name.split("_")[0]
    return lambda spark, sf: apply_op(dirty(spark, sf, dirt), op_id, **params)


# ---------------------------------------------------------------------------------------------------------------------
# Everything else


def sql_clean(options: dict | None = None) -> list[str]:
    """The default clean as steps."""
    ops = cleaner.enabled_ops(options)
    out = [NEWLINES]
    for i in OPS:
        if i in ops:
            out += SQL_OPS[i][2]
    return out


_TAGGED = "p div span br a ul ol li table tr td h1 h2 h3 h4 h5 h6 strong em b i img body html font".split()
HTML_STEPS = [
    sql_rx("t", "(?s)<!--.*?-->"),
    sql_rx("t", "(?i)<!doctype[^>]*>"),
    *[sql_rx("t", f"(?is)<{x}\\b[^>]*>.*?</{x}>") for x in "script style noscript head title svg math".split()],
]
PAGE_ENTITIES = [("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&quot;", '"'), ("&amp;", "&")]
TIDY = [sql_rx("t", f"{C.HS}+", " "), sql_rx("t", " *\\n *", "\n"), sql_rx("t", "\\n{3,}", "\n\n"), sql_trim("t")]
_BLOCK = "address|article|aside|blockquote|div|dd|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|main|nav|ol|p|pre|section|table|tbody|tfoot|thead|ul"
HTML_TO_TEXT = [
    *HTML_STEPS,
    sql_rx("t", "(?i)<li\\b[^>]*>", "\n- "),
    sql_rx("t", "(?i)<hr\\b[^>]*>", "\n\n---\n\n"),
    sql_rx("t", "(?i)</?(?:br|tr)\\b[^>]*>", "\n"),
    sql_rx("t", f"(?i)</?(?:{_BLOCK})\\b[^>]*>", "\n\n"),
    sql_rx("t", "(?i)</?[a-z][a-z0-9-]*\\b[^>]*>"),
    sql_replace("t", PAGE_ENTITIES),
    *TIDY,
]
_JUNK = "^(?i:" + "|".join(typography.TRACKING.split()) + ")$"
URL_SQL = f"""
WITH a AS (SELECT page_id, url, split_part(url, '#', 1) AS head FROM pages),
b AS (SELECT *, split_part(head, '?', 1) AS base, url[len(head) + 1:] AS fragment,
  list_filter(string_split(head[len(split_part(head, '?', 1)) + 2:], '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), {q(_JUNK)})) AS kept FROM a)
SELECT page_id, CASE WHEN contains(head, '?') THEN base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || fragment ELSE url END AS url FROM b
"""
_W = "[\\p{L}\\p{N}][\\p{L}\\p{N}'\\x{2019}._-]*"
_SENTENCE = f"[.!?\\x{{2026}}]+[{C.WS_BODY}{_CLOSE})]|\\n"


def sql_count(pattern: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def sql_filled(parts: str) -> str:
    return f"len(list_filter({parts}, lambda x: regexp_matches(x, {q(C.NOT_WS)})))"


STATS_COLUMNS = f"""
  len(t) AS characters, len({sql_rx('t', f'{C.WS}+')}) AS "charactersNoSpaces", len(w) AS words,
  len(list_distinct(list_transform(w, lambda x: lower(x)))) AS "uniqueWords", {sql_filled(f'string_split_regex(t, {q(_SENTENCE)})')} AS sentences,
  {sql_filled(f"string_split_regex(t, {q(chr(92) + 'n' + C.WS + '*' + chr(92) + 'n')})")} AS paragraphs, CASE WHEN t = '' THEN 0 ELSE len({sql_lines('t')}) END AS lines,
  octet_length(encode(t)) AS bytes, list_max(list_transform({sql_lines('t')}, lambda x: len(x))) AS "longestLine",
  len(w) / 238.0::DOUBLE AS "readingMinutes", len(w) / 140.0::DOUBLE AS "speakingMinutes",
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(array_to_string(w, '')) / len(w)::DOUBLE END AS "averageWordLength"
"""
STATS_SQL = f"WITH s0 AS ({{source}}), s1 AS (SELECT *, regexp_extract_all(t, {q(_W)}) AS w FROM s0) SELECT {{key}}, {STATS_COLUMNS} FROM s1"
_STOP = ", ".join(q(w) for w in stats.STOP_WORDS.split())
FREQUENCY_SQL = f"""
WITH a AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, {q(_W)}) AS w FROM documents)),
b AS (SELECT doc_id, pos, {sql_rx('lower(w)', '^[._-]+|[._-]+$')} AS word FROM a),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM b WHERE len(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
SELECT doc_id, rank, word, n AS count FROM d WHERE rank <= 12
"""
CORPUS_FREQUENCY_SQL = f"""
WITH b AS (SELECT {sql_rx('lower(w)', '^[._-]+|[._-]+$')} AS word FROM (SELECT unnest(regexp_extract_all(text, {q(_W)})) AS w FROM documents))
SELECT word, count(*) AS count FROM b WHERE len(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY word ORDER BY count DESC, word LIMIT 12
"""
_LIST_ITEM = f"(regexp_matches(X, {q(f'^[ \\t]*[{_MARK}][ \\t]+')}) OR regexp_matches(X, {q(f'^[ \\t]*{_NUMBER}[ \\t]+')}))"


def _item(x: str) -> str:
    return _LIST_ITEM.replace("X", x)


SCAN_COUNTS = {
    "mojibake": sql_count(C.MOJIBAKE_HINT),
    "replacementChar": sql_count("\\x{FFFD}"),
    "tagChars": sql_count(f"[{C.body(C.TAG_POINTS)}]"),
    "bidi": sql_count(f"[{C.body(C.BIDI_POINTS)}]"),
    "html": f"CASE WHEN regexp_matches(t, {q('(?i)<(?:' + '|'.join(_TAGGED) + '|o:p)' + chr(92) + 'b[^>]*>')}) THEN {sql_count('(?i)<[a-z!/][^>]*>')} ELSE 0 END",
    "hardWrap": "CASE WHEN len(body) < 3 OR list_max(list_transform(body, lambda x: len(x))) > 200 THEN 0 ELSE len(list_filter(range(1, len(body)), lambda i: "
    f"NOT {_item('body[i]')} AND NOT {_item('body[i + 1]')} AND NOT regexp_matches(body[i], '[.!?:;]$') AND regexp_matches(body[i + 1], '^[\\p{{Ll}}0-9]') "
    "AND len(body[i]) > 0.6::DOUBLE * list_max(list_transform(body, lambda x: len(x))))) END",
    "hyphenBreaks": sql_count(f"\\p{{Ll}}[-\\x{{AD}}]\\n{C.HS}*\\p{{Ll}}"),
    "invisibles": sql_count(f"[{C.body(C.INVISIBLE_POINTS)}]"),
    "controls": sql_count(f"[{C.body(C.CONTROL_POINTS)}]"),
    "objects": sql_count(f"[{C.body(C.OBJECT_POINTS)}]"),
    "privateUse": sql_count(f"[{C.body(C.PRIVATE_POINTS)}]"),
    "nbsp": sql_count(f"[{C.body(C.EXOTIC_POINTS)}]"),
    "ligatures": sql_count("[" + "".join(C.LIGATURES) + "]"),
    "entities": sql_count("(?i)&(?:#x?[0-9a-f]+|[a-z][a-z0-9]{1,31});"),
    "emailQuoting": f"len(list_filter({sql_lines('t')}, lambda x: regexp_matches(x, '^[ \\t]*>')))",
    "pageNumbers": f"len(list_filter({sql_lines('t')}, lambda x: regexp_matches(x, {q(f'^{_DIGITS}$')}) OR regexp_matches(x, {q(f'(?i)^{C.WS}*page{C.WS}+[0-9]{{1,4}}({C.WS}+of{C.WS}+[0-9]{{1,4}})?{C.WS}*$')})))",
    "runningHeads": "len(list_filter(body, lambda x: len(x) <= 80 AND len(list_filter(body, lambda y: y = x)) >= 3))",
    "smartQuotes": sql_count(f"[{C.body(C.SMART_QUOTE_POINTS)}]"),
    "dashes": sql_count(f"[{C.body(C.SMART_DASH_POINTS)}]"),
    "bullets": f"len(list_filter({sql_lines('t')}, lambda x: regexp_matches(x, {q(f'^[ \\t]*[{C.body(C.BULLET_POINTS)}{C.body(C.PRIVATE_POINTS)}]')})))",
    "duplicateLines": "len(body) - len(list_distinct(body))",
    "multiSpace": sql_count(f"{C.NOT_WS}{C.HS}{{2,}}{C.NOT_WS}"),
    "trailingSpace": sql_count(f"(?m){C.HS}+$"),
    "tabs": sql_count("\\t"),
    "blankRuns": sql_count("\\n{3,}"),
    "spaceBeforePunctuation": sql_count(f"{C.WS}+[,.;:!?]"),
    "trackingLinks": sql_count("(?i)[?&](?:utm_\\w+|fbclid|gclid|mc_[ce]id|igshid|msclkid)="),
    "emoji": "len(t) - len(replace(t, chr(128512), ''))",
}
_BODY = f"list_filter(list_transform({sql_lines('t')}, lambda x: {sql_trim('x')}), lambda x: x <> '')"


def sql_scan(source: str) -> str:
    counts = ", ".join(f'{e} AS "{i}"' for i, e in SCAN_COUNTS.items())
    return f"WITH s0 AS ({source}), s1 AS (SELECT *, {_BODY} AS body FROM s0), s2 AS (SELECT doc_id, {counts} FROM s1)"


SCAN_LONG_TAIL = (
    ", s3 AS (SELECT doc_id, unnest([" + ", ".join(
        f"{{'ord': {n}, 'rank': {scan.SEVERITIES.index(s)}, 'id': {q(i)}, 'severity': {q(s)}, 'count': \"{i}\"}}" for n, (i, s, _, _) in enumerate(scan.CHECKS)
    ) + "]) AS r FROM s2), s4 AS (SELECT doc_id, r.ord AS ord, r.rank AS rnk, r.id AS id, r.severity AS severity, r.count AS n FROM s3 WHERE r.count > 0) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rnk, n DESC, ord) - 1 AS position, id, severity, n AS count FROM s4"
)
INSPECT_SQL = f"""
WITH s0 AS ({{source}}), a AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS pos FROM (SELECT doc_id, string_split(t, '') AS c FROM s0)),
b AS (SELECT doc_id, c, count(*) AS n, min(pos) AS first FROM a WHERE NOT regexp_matches(c, '[\\n\\t -~]') AND c <> '' GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank, unicode(c) AS cp FROM b)
SELECT doc_id, rank, cp::BIGINT AS code_point, n AS count, 'U+' || lpad(upper(to_hex(cp)), greatest(4, len(to_hex(cp)))::INT, '0') AS label, c AS char FROM d WHERE rank <= 200
"""
DEDUPE_SQL = f"""
WITH s0 AS ({{source}}), a AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {sql_lines('t')} AS l FROM s0)),
b AS (SELECT *, {{key}} AS k FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id, k) AS times,
  lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER ({{keep}}), '') AS text FROM c GROUP BY doc_id
"""


def _dedupe(key: str, keep: str) -> str:
    return fill(DEDUPE_SQL, source=source_sql(LINES), key=key, keep=keep)


_TRIMMED = sql_trim("x")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    out["clean_default"] = lambda s, sf: cleaner.clean(dirty(s, sf, DIRT))
    for name in cleaner.SWITCHES:
        if name != "stripHtml":
            dirt = LINES if name == "joinLines" else DIRT
            out[f"clean_{name}"] = lambda s, sf, n=name, d=dirt: cleaner.clean(dirty(s, sf, d), {n: True})
    out["clean_strip_html"] = lambda s, sf: cleaner.clean(dirty(s, sf, [], "pages", "page_id", "html"), {"stripHtml": True})
    for name, (dirt, params, _) in SQL_OPS.items():
        out[f"op_{name}"] = _op_query(name, dirt, params)
    for name, (dirt, params) in PLAIN_OPS.items():
        out[f"op_{name}"] = _op_query(name, dirt, params)
    for name, params in (("removeRepeatedLines", {}), ("deduplicateLines", {}), ("deduplicateLines_adjacent", {"adjacentOnly": True, "caseSensitive": True})):
        out[f"op_{name}"] = _op_query(name, LINES, params)
    for name in ("htmlToText", "stripTags", "htmlToMarkdown"):
        out[f"op_{name}"] = lambda s, sf, n=name: apply_op(dirty(s, sf, [], "pages", "page_id", "html"), n)
    out["op_htmlToText_links"] = lambda s, sf: apply_op(dirty(s, sf, [], "pages", "page_id", "html"), "htmlToText", keepLinks=True)
    out["op_htmlToText_flat"] = lambda s, sf: apply_op(dirty(s, sf, [], "pages", "page_id", "html"), "htmlToText", keepStructure=False)
    out["op_encode_base64Decode"] = lambda s, sf: apply_op(table(s, sf, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("text")), "encode", mode="base64Decode")
    out["op_changeCase_capital"] = _op_query("changeCase", [], {"mode": "capital"})
    out["urls_without_tracking"] = lambda s, sf: table(s, sf, "pages").select("page_id", typography.clean_url_column(F.col("url")).alias("url"))
    columns: dict[str, tuple[list, Callable[[Column], Column]]] = {
        "fn_remove_bidi": (DIRT, repair.remove_bidi),
        "fn_keep_duplicate_lines": (LINES, linewise.keep_duplicate_lines),
        "fn_space_before_units": ([(" the ", " 5kg ")], spacing.space_before_units),
        "fn_trim_lines": (DIRT, spacing.trim_lines),
        "fn_remove_emoji_and_symbols": (DIRT, repair.remove_emoji_and_symbols),
    }
    for name, (dirt, f) in columns.items():
        out[name] = lambda s, sf, d=dirt, f=f: dirty(s, sf, d).select("doc_id", f(F.col("text")).alias("text"))
    out["fn_count_matches"] = lambda s, sf: table(s, sf, "documents").select("doc_id", replace.count_matches(F.col("text"), "the").cast("long").alias("n"))
    for name in cleaner.TOOLS:
        if name == "stripHtml":
            out["tool_stripHtml"] = out["clean_strip_html"]
            continue
        step = {"id": name, "params": {"find": "the", "replace": "THE"}}
        out[f"tool_{name}"] = lambda s, sf, st=step: cleaner.apply_steps(dirty(s, sf, LINES), [st])
    out["scan_wide"] = lambda s, sf: scan.scan_wide(dirty(s, sf, DIRT))
    out["scan_long"] = lambda s, sf: scan.scan_long(dirty(s, sf, DIRT), "doc_id")
    out["scan_lines"] = lambda s, sf: scan.scan_wide(dirty(s, sf, LINES))
    out["inspect_characters_topk"] = lambda s, sf: scan.inspect_characters(dirty(s, sf, DIRT), "doc_id").select("doc_id", "rank", "code_point", "count", "label", "char")
    out["inspect_character_names"] = lambda s, sf: scan.inspect_characters(dirty(s, sf, DIRT), "doc_id").select("doc_id", "rank", "name", "printable")
    out["mark_counts"] = lambda s, sf: scan.mark_counts(dirty(s, sf, DIRT), "doc_id")
    out["doc_stats"] = lambda s, sf: stats.doc_stats(table(s, sf, "documents").select("doc_id", "text"))
    out["conversation_stats"] = lambda s, sf: stats.doc_stats(table(s, sf, "conversations").select("conv_id", "turn", "text"))
    out["word_frequency"] = lambda s, sf: stats.word_frequency(table(s, sf, "documents"), "doc_id")
    out["ext_corpus_word_frequency"] = lambda s, sf: stats.word_frequency(table(s, sf, "documents"), None)
    out["summarise_change"] = lambda s, sf: _changed(s, sf).select("doc_id", F.inline(F.array(stats.summarise_change(F.col("raw"), F.col("text")))))
    out["format_numbers"] = lambda s, sf: table(s, sf, "documents").select(
        "doc_id", stats.format_bytes(F.col("n_chars")).alias("size"), stats.format_count(F.col("n_chars")).alias("chars"), stats.format_duration(F.col("n_chars") / F.lit(1000.0)).alias("time")
    )
    out["describe_changes"] = lambda s, sf: _changed(s, sf).select("doc_id", F.array_join(cleaner.describe_changes(F.col("raw"), F.col("text")), " ").alias("said"))
    out["suggestions"] = lambda s, sf: dirty(s, sf, LINES).select("doc_id", F.array_join(F.transform(cleaner.suggestions(F.col("text")), lambda x: x["id"]), ",").alias("ids"))
    out["ext_stats_by_language"] = lambda s, sf: _by_language(s, sf)
    out["ext_frequent_lines"] = lambda s, sf: relational.frequent_lines(table(s, sf, "documents"), "doc_id")
    out["ext_extract_rows"] = lambda s, sf: relational.extracted(table(s, sf, "documents"), "doc_id", "ips").withColumn("position", F.col("position").cast("long"))
    out["ext_deduplicate_relational"] = lambda s, sf: relational.implode_lines(relational.deduplicated(relational.explode_lines(dirty(s, sf, LINES), "doc_id"), "doc_id"), "doc_id")
    return out


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    raw = dirty(spark, sf, DIRT).withColumn("raw", F.col("text"))
    return run_pipeline(raw, cleaner.enabled_ops())


def _by_language(spark: SparkSession, sf: str) -> DataFrame:
    d = stats.doc_stats(table(spark, sf, "documents").select("lang", "text"))
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("bytes").alias("bytes"))


def sql_described(before: str, after: str) -> str:
    """What ``describe_changes`` says with the default switches, of the scans of two sources of (doc_id, t)."""
    on = set(cleaner.enabled_ops())

    def parts(fixes) -> str:
        out = ["NULL::VARCHAR"]
        for check, ops, phrase, *more in fixes:
            if not on & set(ops.split()):
                continue
            n = f'(w."{check}" - n."{check}")'
            number = lambda one, many, n=n: f"{n} || ' ' || CASE WHEN {n} = 1 THEN {q(one)} ELSE {q(many)} END"
            said = number(phrase, *more) if len(more) == 1 else f"{q(phrase)} || {number(*more)}" if more else q(phrase)
            out.append(f"CASE WHEN {n} > 0 THEN {said} END")
        return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"

    most = cleaner.MOST_LISTED
    others = f"(len(f) - {most - 1}) || ' ' || CASE WHEN len(f) = {most} THEN 'other fix' ELSE 'other fixes' END"
    listed = lambda x: f"CASE WHEN len({x}) < 2 THEN array_to_string({x}, '') ELSE array_to_string({x}[:-2], ', ') || ' and ' || {x}[-1] END"
    return (
        f"WITH w AS (SELECT * FROM ({sql_scan(before)} SELECT * FROM s2)), n AS (SELECT * FROM ({sql_scan(after)} SELECT * FROM s2)), "
        f"p AS (SELECT doc_id, {parts(cleaner.CHARACTER_FIXES)} AS f, {parts(cleaner.STRUCTURE_FIXES)} AS a FROM w JOIN n USING (doc_id)), "
        f"c AS (SELECT doc_id, CASE WHEN len(f) > {most} THEN list_append(f[:{most - 1}], {others}) ELSE f END AS f, a FROM p), "
        f"l AS (SELECT doc_id, CASE WHEN len(f) > 0 THEN 'Fixed ' || {listed('f')} || '.' END AS f, {listed('a')} AS a FROM c) "
        "SELECT doc_id, concat_ws(' ', f, CASE WHEN a <> '' THEN upper(a[1]) || a[2:] || '.' END) AS said FROM l"
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["clean_default"] = steps(source_sql(DIRT), sql_clean())
    for name in ("keepQuotes", "removeEmojis", "oneLine", "removeBullets"):
        out[f"clean_{name}"] = steps(source_sql(DIRT), sql_clean({name: True}))
    for name, (dirt, _, exprs) in SQL_OPS.items():
        out[f"op_{name}"] = steps(source_sql(dirt), [NEWLINES, *exprs])
    pages = source_sql([], "pages", "page_id", "html")
    page = {"select": "page_id, t AS text", "key": "page_id"}
    out["op_htmlToText"] = steps(pages, [NEWLINES, *HTML_TO_TEXT], **page)
    out["op_stripTags"] = steps(pages, [NEWLINES, HTML_STEPS[0], *HTML_STEPS[2:4], sql_rx("t", "<[^>]*>"), sql_replace("t", PAGE_ENTITIES)], **page)
    out["op_htmlToText_flat"] = steps(pages, [NEWLINES, *HTML_STEPS, sql_rx("t", "(?i)</?[a-z][a-z0-9-]*\\b[^>]*>", " "), sql_replace("t", PAGE_ENTITIES), sql_rx("t", f"{C.WS}+", " "), sql_trim("t")], **page)
    after_html = [e for i in OPS if i in cleaner.enabled_ops() for e in SQL_OPS[i][2]]
    out["clean_strip_html"] = out["tool_stripHtml"] = steps(pages, [NEWLINES, *HTML_TO_TEXT, *after_html], **page)
    out["op_removeRepeatedLines"] = _dedupe(_TRIMMED, "k = '' OR len(k) > 80 OR times < 3")
    out["op_deduplicateLines"] = _dedupe(f"lower({_TRIMMED})", "k = '' OR n = 1")
    out["ext_deduplicate_relational"] = out["tool_dedupe"] = out["op_deduplicateLines"]
    out["op_deduplicateLines_adjacent"] = _dedupe(_TRIMMED, "before IS NULL OR k <> before")
    out["fn_keep_duplicate_lines"] = _dedupe(_TRIMMED, "k <> '' AND times > 1 AND n = 1")
    out["op_encode_base64Decode"] = "SELECT doc_id, text FROM documents"
    piece = "(?s)\\p{L}[\\p{L}\\p{M}'\\x{2019}]*|\\P{L}+"
    letters = sql_rx("x", "[^\\p{L}]")
    meant = f"(len({letters}) >= 2 AND ({letters} = {sql_upper(letters)} OR regexp_matches(x, '\\p{{Ll}}\\p{{Lu}}')))"
    capital = f"CASE WHEN NOT regexp_matches(x, '^\\p{{L}}') OR {meant} THEN x ELSE {sql_first('x')} END"
    out["op_changeCase_capital"] = steps(source_sql([]), [f"array_to_string(list_transform(regexp_extract_all(t, {q(piece)}), lambda x: {capital}), '')"])
    out["urls_without_tracking"] = URL_SQL
    out["fn_remove_bidi"] = steps(source_sql(DIRT), [sql_rx("t", f"[{C.body(C.BIDI_POINTS)}]")])
    units = spacing.UNITS.replace("%", "").split()
    out["fn_space_before_units"] = steps(source_sql([(" the ", " 5kg ")]), [sql_rx("t", f"(?i)([0-9])((?:{'|'.join(units)})\\b)", "\\1 \\2")])
    out["fn_trim_lines"] = steps(source_sql(DIRT), SQL_OPS["trimLines"][2])
    out["fn_remove_emoji_and_symbols"] = steps(source_sql(DIRT), ["replace(t, chr(128512), '')"])
    out["fn_count_matches"] = "SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS n FROM documents"
    lined = source_sql(LINES)
    out["tool_upper"] = steps(lined, [sql_upper("t")])
    out["tool_lower"] = steps(lined, ["lower(t)"])
    out["tool_removeEmpty"] = steps(lined, SQL_OPS["removeEmptyLines"][2])
    out["tool_replace"] = steps(lined, [sql_rx("t", "(?i)the", "THE")])
    plain = ["straightenQuotes", "straightenDashes", "asciiSymbols", "transliterate", "removeEmoji"]
    out["tool_ascii"] = steps(lined, [e for i in plain for e in SQL_OPS[i][2]] + [sql_rx("t", "[^\\n\\t -~]"), sql_rx("t", f"{C.HS}{{2,}}", " "), sql_rx("t", f"(?m){C.HS}+$")])
    out["scan_wide"] = sql_scan(source_sql(DIRT)) + " SELECT * FROM s2"
    out["scan_lines"] = sql_scan(source_sql(LINES)) + " SELECT * FROM s2"
    out["scan_long"] = sql_scan(source_sql(DIRT)) + SCAN_LONG_TAIL
    out["inspect_characters_topk"] = fill(INSPECT_SQL, source=source_sql(DIRT))
    kinds = {k: f"[{b}]" for k, b in scan.MARKS} | {"other": "[^\\n -~" + "".join(b for _, b in scan.MARKS) + "]"}
    out["mark_counts"] = steps(source_sql(DIRT), [NEWLINES], "doc_id, " + ", ".join(f'{sql_count(p)} AS "{k}"' for k, p in kinds.items()))
    names = " ".join(f"WHEN cp = {cp} THEN {q(text)}" for cp, text in C.CHARACTER_NAMES.items())
    hidden = " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in C.ranges(C.UNPRINTABLE_POINTS))
    named = (
        f"CASE {names} WHEN cp BETWEEN 917504 AND 917631 THEN 'invisible tag character' WHEN cp BETWEEN 57344 AND 63743 THEN 'private-use glyph (font-specific)' "
        "WHEN cp BETWEEN 768 AND 879 THEN 'combining accent' WHEN cp < 32 OR cp BETWEEN 127 AND 159 THEN 'control character' "
        "WHEN cp >= 126976 THEN 'emoji or pictograph' ELSE 'non-ASCII character' END"
    )
    ranked, _, _ = fill(INSPECT_SQL, source=source_sql(DIRT)).rpartition("SELECT doc_id, rank")
    out["inspect_character_names"] = f"{ranked}SELECT doc_id, rank, {named} AS name, NOT ({hidden}) AS printable FROM d WHERE rank <= 200"
    tenth = lambda x: f"printf('%.1f', {x} + CASE WHEN ({x} * 4) % 2 = 1 THEN 0.01 ELSE 0 END)"  # noqa: E731  exact halves upwards
    kb = "regexp_replace(" + tenth("(n_chars / {0})") + ", '\\.0$', '') || '{1}'"
    minutes = "(n_chars / 1000.0::DOUBLE)"
    out["format_numbers"] = (
        "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN " + tenth("(n_chars / 1024.0::DOUBLE)") + " || ' KB' ELSE " + tenth("(n_chars / 1048576.0::DOUBLE)") + " || ' MB' END AS size, "
        f"CASE WHEN n_chars < 10000 THEN format('{{:,}}', n_chars) WHEN n_chars < 1000000 THEN {kb.format('1e3::DOUBLE', 'k')} ELSE {kb.format('1e6::DOUBLE', 'M')} END AS chars, "
        f"CASE WHEN {minutes} = 0 THEN '0 sec' WHEN {minutes} < 1 THEN greatest(1, floor({minutes} * 60 + 0.5))::BIGINT || ' sec' WHEN {minutes} < 60 THEN floor({minutes} + 0.5)::BIGINT || ' min' "
        f"ELSE floor({minutes} / 60)::BIGINT || ' hr ' || floor({minutes} - floor({minutes} / 60) * 60 + 0.5)::BIGINT || ' min' END AS time FROM documents"
    )
    broken = " OR ".join(f'"{check}" > 0' for checks, _ in cleaner.REASONS for check in checks.split())
    out["suggestions"] = sql_scan(steps(lined, [NEWLINES], "doc_id, t")) + f""" SELECT doc_id, concat_ws(',', CASE WHEN {broken} THEN 'joinLines' END, CASE WHEN html > 0 THEN 'stripHtml' END) AS ids FROM s2"""
    out["describe_changes"] = sql_described(steps(source_sql(DIRT), [NEWLINES], "doc_id, t"), steps(source_sql(DIRT), sql_clean(), "doc_id, t"))
    out["doc_stats"] = fill(STATS_SQL, source="SELECT doc_id, text AS t FROM documents", key="doc_id")
    out["conversation_stats"] = fill(STATS_SQL, source="SELECT conv_id, turn, text AS t FROM conversations", key="conv_id, turn")
    out["word_frequency"] = FREQUENCY_SQL
    out["ext_corpus_word_frequency"] = CORPUS_FREQUENCY_SQL
    cleaned = steps(source_sql(DIRT), sql_clean(), "doc_id, t AS c")
    out["summarise_change"] = (
        f"WITH r AS ({source_sql(DIRT)}), c AS ({cleaned}) SELECT doc_id, len(r.t) - len(c) AS \"charactersRemoved\", "
        f"CASE WHEN r.t = '' THEN 0 ELSE len({sql_lines('r.t')}) END - CASE WHEN c = '' THEN 0 ELSE len({sql_lines('c')}) END AS \"linesRemoved\", "
        f"len(regexp_extract_all(c, {q(_W)})) - len(regexp_extract_all(r.t, {q(_W)})) AS \"wordsChanged\", r.t <> c AS changed FROM r JOIN c USING (doc_id)"
    )
    out["ext_stats_by_language"] = (
        f"SELECT lang, count(*) AS documents, sum(len(regexp_extract_all(text, {q(_W)})))::BIGINT AS words, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang"
    )
    out["ext_frequent_lines"] = (
        f"WITH a AS (SELECT doc_id, {sql_trim('x')} AS line FROM (SELECT doc_id, unnest({sql_lines('text')}) AS x FROM documents)) "
        "SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM a WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2"
    )
    ips = "regexp_extract_all(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')"
    out["ext_extract_rows"] = f"SELECT doc_id, unnest(range(len({ips}))) AS position, unnest({ips}) AS value FROM documents"
    return out

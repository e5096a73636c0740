"""Encodings of a whole text. What cannot be decoded stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import WS
from textloom.functions.core import let, replace_all, rx


def url_encode(t: Column) -> Column:
    """Percent encoding as in a link's part, not as in a form."""
    return replace_all(F.url_encode(t), [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")])


def url_decode(t: Column) -> Column:
    lost = chr(0xFFFD)
    decoded = F.try_url_decode(t)
    broken = F.contains(decoded, F.lit(lost)) & ~F.contains(t, F.lit(lost)) & ~F.contains(F.upper(t), F.lit("%EF%BF%BD"))
    return F.when(broken, t).otherwise(F.coalesce(decoded, t))


def base64_encode(t: Column) -> Column:
    return F.replace(F.base64(F.encode(t, "UTF-8")), F.lit("\r\n"), F.lit(""))


def base64_decode(t: Column) -> Column:
    def decoded(packed: Column) -> Column:
        bare = F.when(F.length(packed) % 4 == 0, rx(packed, "={1,2}\\z")).otherwise(packed)

        def whole(b: Column) -> Column:
            good = b.rlike("^[A-Za-z0-9+/]*\\z") & (F.length(b) % 4 != 1)
            padded = F.concat(b, F.repeat(F.lit("="), F.pmod(-F.length(b), F.lit(4))))
            return F.when(good, rx(F.make_valid_utf8(F.unbase64(padded).cast("string")), "^\\x{FEFF}")).otherwise(t)

        return let(bare, whole)

    return let(rx(t, f"{WS}+"), decoded)


def json_escape(t: Column) -> Column:
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    slashed = replace_all(t, [("\\", "\\\\"), ('"', '\\"')])
    controls = [(chr(c), named.get(c, f"\\u{c:04x}")) for c in range(32)]
    return F.when(t.rlike("[\\x{0}-\\x{1F}]"), replace_all(slashed, controls)).otherwise(slashed)


def json_unescape(t: Column) -> Column:
    prepared = rx(F.replace(t, F.lit("\n"), F.lit("\\n")), '(^|[^\\\\])"', '$1\\\\"')
    parsed = F.from_json(F.concat(F.lit('{"a":"'), prepared, F.lit('"}')), "a string")["a"]
    return F.coalesce(parsed, t)


def csv_field(t: Column) -> Column:
    return F.concat(F.lit('"'), rx(F.replace(t, F.lit('"'), F.lit('""')), "\\r?\\n", " "), F.lit('"'))


MODES = {
    "urlEncode": url_encode,
    "urlDecode": url_decode,
    "base64Encode": base64_encode,
    "base64Decode": base64_decode,
    "jsonEscape": json_escape,
    "jsonUnescape": json_unescape,
    "csv": csv_field,
}


def encode(t: Column, mode: str = "urlEncode") -> Column:
    """Unknown modes change nothing."""
    return MODES[mode](t) if mode in MODES else t

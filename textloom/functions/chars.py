"""Character tables and the pattern pieces built from them. Patterns are written for Java's regular expressions.

All non-ASCII characters are given by code point.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------------------------------
# Code points, ranges and spellings that results depend on.

#: White space as a browser sees it.
SPACE_POINTS = "9-D 20 A0 1680 2000-200A 2028-2029 202F 205F 3000 FEFF"
#: Unusual spaces that become U+0020.
EXOTIC_POINTS = "A0 1680 2000-200A 202F 205F 3000"
INVISIBLE_POINTS = "AD 61C 180E 200B-200F 202A-202E 2060-2064 2066-206F FE00-FE0E FEFF FFF9-FFFB E0100-E01EF"
TAG_POINTS = "E0000-E007F"
BIDI_POINTS = "61C 200E 200F 202A-202E 2066-2069"
CONTROL_POINTS = "0-8 B C E-1F 7F-9F"
OBJECT_POINTS = "FFFC FFFD"
PRIVATE_POINTS = "E000-F8FF"
COMBINING_POINTS = "300-36F"
BULLET_POINTS = "2022 2023 25AA 25AB 25CF 25CB 25E6 2043 204C 204D 2219 B7 A7 2751"
MARKER_POINTS = BULLET_POINTS + " E000-F8FF 2D 2013 2014 2A 2B"
OPEN_QUOTE_POINTS = "22 27 201C 2018"
CLOSE_QUOTE_POINTS = "22 27 201D 2019"
SMART_QUOTE_POINTS = "2018 2019 201A 201B 201C 201D 201E 201F 2032 2033 AB BB"
SMART_DASH_POINTS = "2010-2015 2212"
MOJIBAKE_LEAD_POINTS = "C2 C3 E2 C5 D0"
MOJIBAKE_NEXT_POINTS = "80-BF 2013 2014 2018 2019 201A 201C 201D 201E 20AC 2122 2026"

LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st",
    "\u0132": "IJ", "\u0133": "ij", "\ua728": "TZ", "\ua729": "tz",
}
SINGLE_QUOTES = "2018 2019 201A 201B 2032 2035 2BC 2B9 FF07 2039 203A"
DOUBLE_QUOTES = "201C 201D 201E 201F 2033 2036 2BA FF02 AB BB"
DASHES = "2010 2011 2012 2013 2014 2015 2212 2043 FE58 FE63 FF0D"
SYMBOLS = {
    "\u2026": "...", "\u2024": ".", "\u2025": "..", "\u2022": "-", "\u2023": "-", "\u25aa": "-", "\u25ab": "-", "\u25cf": "-",
    "\u25cb": "-", "\u25e6": "-", "\u204c": "-", "\u204d": "-", "\u2219": "-", "\xb7": "-", "\xbc": "1/4", "\xbd": "1/2",
    "\xbe": "3/4", "\u2044": "/", "\u2122": "(TM)", "\xae": "(R)", "\xa9": "(C)", "\u2117": "(P)", "\xd7": "x", "\u2260": "!=",
    "\u2264": "<=", "\u2265": ">=", "\xb0": " degrees", "\u2192": "->", "\u2190": "<-", "\u2194": "<->", "\u21d2": "=>",
    "\u2020": "*", "\u2021": "**", "\u2030": "%",
}
TRANSLITERATIONS = {
    "\xe6": "ae", "\xc6": "AE", "\u0153": "oe", "\u0152": "OE", "\xdf": "ss", "\u1e9e": "SS", "\xf8": "o", "\xd8": "O",
    "\u0111": "d", "\u0110": "D", "\xf0": "d", "\xd0": "D", "\xfe": "th", "\xde": "TH", "\u0142": "l", "\u0141": "L",
    "\u0127": "h", "\u0126": "H", "\u0131": "i", "\u014b": "ng", "\u014a": "NG", "\u20ac": "EUR", "\xa3": "GBP", "\xa5": "JPY",
    "\xa2": "c", "\u2116": "No.", "\xb5": "u",
}
#: Characters whose doubly encoded forms are repaired one by one.
MOJIBAKE_TARGETS = (
    "2018 2019 201A 201C 201D 201E 2013 2014 2026 2022 2039 203A A0 A9 AE 2122 B0 B7 BD BC BE 20AC A3 A5 "
    "2032 2033 AB BB 2212 D7 2192 2190 E0 E1 E2 E3 E4 E5 E7 E8 E9 EA EB ED EE EF F1 F3 F4 F6 F8 FA FB FC "
    "FD FF C9 D6 DC DF 161 17E 153"
)
#: Pictographs that are ordinary typography unless U+FE0F follows.
TEXT_SYMBOL_POINTS = (
    "A9 AE 203C 2049 2122 2139 24C2 2194-2199 21A9 21AA 27A1 2B05-2B07 2934 2935 25AA 25AB 25B6 25C0 25FB 25FC "
    "2640 2642 265F 2660 2663 2665 2666 2668 267B 267E 2611 2714 2716 2733 2734 2747 3030 303D 23CF 23ED-23EF "
    "23F8-23FA 2622 2623 2626 262A 262E 262F 2638 271D 2721 2692 2694 2695 2696 2697 2699 269B 269C 26A0 26A7"
)
#: The Unicode property Extended_Pictographic, which Java 17 lacks.
PICTOGRAPH_POINTS = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE "
    "2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 "
    "2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 "
    "26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 "
    "2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 "
    "3030 303D 3297 3299 1F004 1F02C-1F02F 1F094-1F09F 1F0AF-1F0B0 1F0C0 1F0CF-1F0D0 1F0F6-1F0FF 1F170-1F171 1F17E-1F17F 1F18E "
    "1F191-1F19A 1F1AE-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F25F 1F266-1F321 1F324-1F393 1F396-1F397 "
    "1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F3FA 1F400-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A "
    "1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 "
    "1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6E5 1F6E9 1F6EB-1F6F0 1F6F3-1F6FF 1F7DA-1F7FF 1F80C-1F80F "
    "1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8AF 1F8BC-1F8BF 1F8C2-1F8CF 1F8D9-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1F9FF "
    "1FA58-1FA5F 1FA6E-1FAFF 1FC00-1FFFD"
)
CHARACTER_NAMES = {
    0x09: "tab", 0x0A: "line feed", 0x0D: "carriage return", 0x20: "space", 0xA0: "no-break space", 0xAD: "soft hyphen",
    0x200B: "zero-width space", 0x200C: "zero-width non-joiner", 0x200D: "zero-width joiner", 0xFEFF: "byte order mark",
    0x2018: "left single quote", 0x2019: "right single quote or apostrophe", 0x201C: "left double quote", 0x201D: "right double quote",
    0x2013: "en dash", 0x2014: "em dash", 0x2026: "horizontal ellipsis", 0x2022: "bullet", 0x202F: "narrow no-break space", 0x2009: "thin space",
    0x2002: "en space", 0x2003: "em space", 0x3000: "ideographic space", 0xFFFC: "object replacement (image or embed)",
    0xFFFD: "replacement character (the original is already lost)", 0xFB00: "ligature ff", 0xFB01: "ligature fi", 0xFB02: "ligature fl",
    0x2028: "line separator", 0x2029: "paragraph separator",
}
#: Code points without a visible shape of their own.
UNPRINTABLE_POINTS = "0-1F 7F-A0 200B-200F 2028-202E 2060-206F FEFF FFFC E000-F8FF E0000-E007F FE00-FE0F"
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": "\x22", "apos": "'", "nbsp": "\xa0", "copy": "\xa9", "reg": "\xae",
    "trade": "\u2122", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "sbquo": "\u201a", "bdquo": "\u201e", "laquo": "\xab", "raquo": "\xbb",
    "bull": "\u2022", "middot": "\xb7", "deg": "\xb0", "plusmn": "\xb1", "frac12": "\xbd", "frac14": "\xbc", "frac34": "\xbe",
    "times": "\xd7", "divide": "\xf7", "minus": "\u2212", "euro": "\u20ac", "pound": "\xa3", "yen": "\xa5", "cent": "\xa2",
    "sect": "\xa7", "para": "\xb6", "dagger": "\u2020", "Dagger": "\u2021", "permil": "\u2030", "prime": "\u2032",
    "Prime": "\u2033", "lsaquo": "\u2039", "rsaquo": "\u203a", "oline": "\u203e", "frasl": "\u2044", "larr": "\u2190",
    "uarr": "\u2191", "rarr": "\u2192", "darr": "\u2193", "harr": "\u2194", "rArr": "\u21d2", "hArr": "\u21d4",
    "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "zwnj": "\u200c", "zwj": "\u200d", "shy": "\xad", "eacute": "\xe9",
    "egrave": "\xe8", "agrave": "\xe0", "ccedil": "\xe7", "uuml": "\xfc", "ouml": "\xf6", "auml": "\xe4", "szlig": "\xdf",
    "ntilde": "\xf1", "aacute": "\xe1", "iacute": "\xed", "oacute": "\xf3", "uacute": "\xfa", "oslash": "\xf8", "aring": "\xe5",
    "aelig": "\xe6", "ecirc": "\xea", "ocirc": "\xf4", "acirc": "\xe2", "icirc": "\xee", "Eacute": "\xc9", "Ouml": "\xd6",
    "Uuml": "\xdc", "Auml": "\xc4",
}
# ---------------------------------------------------------------------------------------------------------------------


def ranges(points: str) -> list[tuple[int, int]]:
    """``"41-5A 61"`` as [(0x41, 0x5A), (0x61, 0x61)]."""
    out = []
    for part in points.split():
        low, _, high = part.partition("-")
        out.append((int(low, 16), int(high or low, 16)))
    return out


def body(points: str) -> str:
    """The inside of a character class, for Java and RE2 alike."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges(points))


def characters(points: str) -> str:
    return "".join(chr(c) for a, b in ranges(points) for c in range(a, b + 1))


def misread(b: int) -> str:
    """What a reader of Windows-1252 shows for a byte; the five bytes that it leaves undefined stand for themselves."""
    return bytes([b]).decode("cp1252", "ignore") or chr(b)


def cp1252() -> dict[str, str]:
    """Control characters 80 to 9F with what Windows-1252 has in their place; undefined ones map to themselves."""
    return {chr(b): misread(b) for b in range(0x80, 0xA0)}


def mojibake_pairs() -> list[tuple[str, str]]:
    """(broken, meant) for each target: its UTF-8 bytes as a reader of Windows-1252 shows them. Three bytes come before two, which they may begin with."""
    known = {"".join(map(misread, c.encode())): c for c in characters(MOJIBAKE_TARGETS)}
    return sorted(known.items(), key=lambda pair: (-len(pair[0]), pair))


#: White space, and white space other than line feeds, as class bodies and classes.
WS_BODY = body(SPACE_POINTS)
HS_BODY = body(SPACE_POINTS.replace("9-D", "9 B-D"))
WS, NOT_WS, HS = f"[{WS_BODY}]", f"[^{WS_BODY}]", f"[{HS_BODY}]"
#: A word edge that only knows ASCII letters, digits and the underscore.
WB = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

PICTO = f"[{body(PICTOGRAPH_POINTS)}]"
SKIN = "[\\x{1F3FB}-\\x{1F3FF}]"
ZWJ, VS16 = "\\x{200D}", "\\x{FE0F}"
FLAG_TAGS = "[\\x{E0030}-\\x{E0039}\\x{E0061}-\\x{E007A}]{1,6}\\x{E007F}"
_SHOWN = f"(?:{VS16}|{SKIN})"
_PART = f"(?:{PICTO}{_SHOWN}+|(?![{body(TEXT_SYMBOL_POINTS)}]){PICTO}{_SHOWN}*)(?:{FLAG_TAGS})?"
#: Where an emoji can begin: a few wide ranges turn most characters away before the exact ones are tried.
_BEGIN = "(?=[0-9#*\\x{A9}\\x{AE}\\x{203C}-\\x{3299}\\x{1F004}-\\x{1FFFD}])"
EMOJI = f"{_BEGIN}(?:[0-9#*]{VS16}?\\x{{20E3}}|[\\x{{1F1E6}}-\\x{{1F1FF}}]{{1,2}}|{_PART}(?:{ZWJ}{PICTO}{_SHOWN}*)*|{SKIN})"
#: What holds an emoji together, in a consuming form: Java cannot look behind at characters beyond U+FFFF.
GLUE = f"(?=[\\x{{A9}}\\x{{AE}}\\x{{203C}}-\\x{{3299}}\\x{{FE0F}}\\x{{1F004}}-\\x{{1FFFD}}])(?:{PICTO}|{SKIN}|{VS16}){ZWJ}(?={PICTO})|\\x{{1F3F4}}{FLAG_TAGS}"
MOJIBAKE_HINT = f"[{body(MOJIBAKE_LEAD_POINTS)}][{body(MOJIBAKE_NEXT_POINTS)}]"

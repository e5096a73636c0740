"""Find and replace, removal, extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import WB, WS_BODY
from textloom.functions.core import group_count, group_names, java_pattern, java_replacement, literal, quoted, rx, trim, unlines, valid_pattern, with_rest

#: What can be extracted (fixed values, in Java's syntax).
PATTERNS = {
    "emails": r"[\w.+-]+@[\w-]+\.[\w.-]+\w",
    "urls": f"(?i){WB}https?://[^{WS_BODY}<>\"')\\]]+|{WB}www\\.[^{WS_BODY}<>\"')\\]]+",
    "numbers": r"-?[0-9][0-9,]*(?:\.[0-9]+)?",
    "hashtags": r"#[\p{L}0-9_]+",
    "mentions": r"@[\w.]+",
    "ips": f"{WB}(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}{WB}",
    "dates": f"{WB}[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}{WB}",
    "phones": f"\\+?[0-9][0-9{WS_BODY}().-]{{7,}}[0-9]",
}


def search_pattern(find: str = "", regex: bool = False, matchCase: bool = False, wholeWord: bool = False) -> str | None:
    """The search as a Java pattern; None if there is nothing to find or the pattern is bad."""
    if not find:
        return None
    source = java_pattern(find) if regex else literal(find)
    if wholeWord:
        source = f"{WB}(?:{source}){WB}"
    flags = "" if matchCase else "(?iu)"
    pattern = flags + ("(?md)" if regex else "") + source
    return pattern if valid_pattern(pattern) else None


def find_replace(t: Column, find: str = "", replace: str = "", regex: bool = False, matchCase: bool = False, wholeWord: bool = False) -> Column:
    pattern = search_pattern(find, regex, matchCase, wholeWord)
    if pattern is None:
        return t
    new = replace.replace("\\n", "\n").replace("\\t", "\t")
    if not regex and matchCase and not wholeWord:
        return F.replace(t, F.lit(find), F.lit(new))
    if not regex:
        return rx(t, pattern, quoted(new))
    return rx(t, with_rest(pattern) if "$'" in new else pattern, java_replacement(new, group_count(find), group_names(find)))


def replace_rules(t: Column, rules=({"find": "", "replace": ""},), regex: bool = False, matchCase: bool = False, wholeWord: bool = False) -> Column:
    for rule in rules or ():
        if rule and rule.get("find"):
            t = find_replace(t, **{"regex": regex, "matchCase": matchCase, "wholeWord": wholeWord, **rule})
    return t


def count_matches(t: Column, find: str = "", regex: bool = False, matchCase: bool = False, wholeWord: bool = False, most: int = 1_000_000) -> Column:
    """Matches, empty ones too; counting stops at ``most``, which is the feature."""
    pattern = search_pattern(find, regex, matchCase, wholeWord)
    return F.lit(0) if pattern is None else F.least(F.regexp_count(t, F.lit(pattern)), F.lit(most))


def remove_characters(t: Column, characters: str = "") -> Column:
    """A hyphen between two characters is a range; a reversed range is an error."""
    if not characters:
        return t
    inside = re.sub(r"([.*+?^${}()|\[\]\\&])", r"\\\1", characters)
    pattern = f"[{inside}]"
    if not valid_pattern(pattern):
        raise ValueError(f"bad character range in {characters!r}")
    return rx(t, pattern)


def remove_punctuation(t: Column, keep: str = ".,'") -> Column:
    kept = "".join(f"\\x{{{ord(c):X}}}" for c in keep)
    return rx(t, f"[\\p{{P}}\\p{{S}}&&[^{kept}]]" if keep else "[\\p{P}\\p{S}]")


def remove_numbers(t: Column) -> Column:
    return rx(t, "[0-9]")


def found(t: Column, pattern: str) -> Column:
    """Matches as an array, trimmed."""
    return F.transform(F.regexp_extract_all(t, F.lit(PATTERNS[pattern]), F.lit(0)), trim)


def extract(t: Column, pattern: str = "urls", unique: bool = True, sort: bool = False) -> Column:
    """One match a line; an unknown pattern leaves the text as it is."""
    if pattern not in PATTERNS:
        return t
    all_found = F.array_distinct(found(t, pattern)) if unique else found(t, pattern)
    if sort:
        rows = F.array_sort(F.transform(all_found, lambda x, i: F.struct(F.collate(x, "UNICODE").alias("k"), i.alias("i"), x.alias("x"))))
        all_found = F.transform(rows, lambda r: r["x"])
    return unlines(all_found)

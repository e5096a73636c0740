"""Cleaning with switches, tools, and an account of what changed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import casing, chars, linewise, markup, repair, replace, spacing, typography
from textloom.functions.core import applied, let, lines, trim
from textloom.operators.scan import counts_of
from textloom.plans.pipeline import run_pipeline

#: Operations that always run, and those that each switch adds (fixed values).
ALWAYS = (
    "fixMojibake fixCp1252 normaliseUnicode removeInvisibles removeControls normaliseSpaces expandLigatures collapseSpaces "
    "trimLines collapseBlankLines fixSpaceBeforePunctuation trimDocument"
)
SWITCHES = {
    "joinLines": "removeEmailQuoting removePageNumbers removeRepeatedLines unwrapParagraphs",
    "removeBullets": "removeListMarkers",
    "keepQuotes": "",
    "oneLine": "dehyphenate removeAllLineBreaks",
    "removeEmojis": "removeEmoji",
    "stripHtml": "htmlToText",
}


@dataclass(frozen=True)
class CleanOptions:
    joinLines: bool = False
    removeBullets: bool = False
    keepQuotes: bool = False
    oneLine: bool = False
    removeEmojis: bool = False
    stripHtml: bool = False

    @classmethod
    def of(cls, options: CleanOptions | dict | None) -> CleanOptions:
        """From a dict too; unknown keys are ignored."""
        if isinstance(options, cls):
            return options
        known = {f.name for f in fields(cls)}
        return cls(**{k: bool(v) for k, v in (options or {}).items() if k in known})


def enabled_ops(options: CleanOptions | dict | None = None) -> list[str]:
    given = CleanOptions.of(options)
    out = ALWAYS.split() + ([] if given.keepQuotes else ["straightenQuotes", "straightenDashes"])
    for name, ops in SWITCHES.items():
        out += ops.split() if getattr(given, name) else []
    return out


def clean(df: DataFrame, options: CleanOptions | dict | None = None, column: str = "text", html_column: str | None = None) -> DataFrame:
    """``html_column`` (boolean, as ``sources.read_files`` gives it): rows whose HTML is stripped whatever the switch says."""
    given = CleanOptions.of(options)
    if html_column and not given.stripHtml:
        raw = repair.newlines(F.coalesce(F.col(column), F.lit("")))
        df = df.withColumn(column, F.when(F.col(html_column), markup.html_to_text(raw)).otherwise(F.col(column)))
    return run_pipeline(df, enabled_ops(given), column=column)


def plain_ascii(t: Column) -> list:
    """The steps to plain ASCII, one projection each."""
    return [
        typography.straighten_quotes, typography.straighten_dashes, typography.ascii_symbols, repair.transliterate, repair.remove_emoji,
        repair.ascii_only, lambda c: spacing.trim_line_ends(spacing.collapse_spaces(c)),
    ]


#: Tools by id: each gives the column functions to run in order; ``stripHtml`` is an option, not a step.
TOOLS = {
    "upper": lambda p: [F.upper],
    "lower": lambda p: [F.lower],
    "sentence": lambda p: [casing.sentence],
    "title": lambda p: [casing.title],
    "sort": lambda p: [linewise.sort_lines],
    "dedupe": lambda p: [linewise.deduplicate_lines],
    "removeEmpty": lambda p: [linewise.remove_empty_lines],
    "replace": lambda p: [lambda t: replace.find_replace(t, **{k: v for k, v in p.items() if k in ("find", "replace", "regex", "matchCase", "wholeWord")})],
    "stripHtml": None,
    "ascii": lambda p: plain_ascii(None),
}


def apply_steps(df: DataFrame, steps: Iterable[dict], column: str = "text") -> DataFrame:
    """Steps ``{"id", "params"}`` in order; unknown ids and options are ignored."""
    for step in steps:
        tool = TOOLS.get(step.get("id"))
        for f in tool(step.get("params") or {}) if tool else ():
            df = applied(df, column, f)
    return df


#: (check, operations that fix it, one, many) (fixed wording).
CHARACTER_FIXES = (
    ("mojibake", "fixMojibake", "garbled character", "garbled characters"),
    ("replacementChar", "removeControls", "broken character", "broken characters"),
    ("invisibles", "removeInvisibles", "invisible character", "invisible characters"),
    ("tagChars", "removeInvisibles", "hidden tag character", "hidden tag characters"),
    ("controls", "removeControls", "control character", "control characters"),
    ("objects", "removeControls", "image placeholder", "image placeholders"),
    ("privateUse", "removeControls", "font-specific symbol", "font-specific symbols"),
    ("nbsp", "normaliseSpaces", "non-breaking space", "non-breaking spaces"),
    ("ligatures", "expandLigatures", "ligature", "ligatures"),
    ("smartQuotes", "straightenQuotes", "curly quote", "curly quotes"),
    ("dashes", "straightenDashes", "long dash", "long dashes"),
    ("multiSpace", "collapseSpaces", "double space", "double spaces"),
    ("trailingSpace", "trimLines", "trailing space", "trailing spaces"),
    ("spaceBeforePunctuation", "fixSpaceBeforePunctuation", "space before punctuation", "spaces before punctuation"),
)
#: (check, operations, phrase) or (check, operations, start of the phrase, one, many) (fixed wording).
STRUCTURE_FIXES = (
    ("html", "htmlToText", "removed HTML tags"),
    ("hyphenBreaks", "unwrapParagraphs dehyphenate", "rejoined ", "hyphenated word", "hyphenated words"),
    ("hardWrap", "unwrapParagraphs", "joined broken lines"),
    ("pageNumbers", "removePageNumbers", "removed page numbers"),
    ("runningHeads", "removeRepeatedLines", "removed repeated headers"),
    ("emailQuoting", "removeEmailQuoting", "removed reply markers"),
    ("emoji", "removeEmoji", "removed ", "emoji", "emojis"),
    ("blankRuns", "collapseBlankLines", "removed extra blank lines"),
)
MOST_LISTED = 5


def _number(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def listed(items: Column) -> Column:
    """``a, b and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, n)))


def _list_items(t: Column) -> Column:
    return F.size(F.filter(lines(t), linewise.is_list_item))


def describe_changes(before: Column, after: Column, options: CleanOptions | dict | None = None) -> Column:
    """Sentences on what cleaning fixed, as an array; empty for an empty text."""
    given = CleanOptions.of(options)
    on = set(enabled_ops(given))
    raw = repair.newlines(F.coalesce(before, F.lit("")))

    def told(was: Column, now: Column) -> Column:
        fixed, acted = [], []
        for check, ops, one, many in CHARACTER_FIXES:
            if on & set(ops.split()):
                n = was[check] - now[check]
                fixed.append(F.when(n > 0, _number(n, one, many)))
        for check, ops, phrase, *number in STRUCTURE_FIXES:
            if on & set(ops.split()):
                n = was[check] - now[check]
                acted.append(F.when(n > 0, F.concat(F.lit(phrase), _number(n, *number)) if number else F.lit(phrase)))
        if "removeListMarkers" in on:
            acted.append(F.when(_list_items(raw) > _list_items(after), F.lit("removed bullets and numbering")))
        if given.oneLine:
            acted.append(F.when(F.contains(trim(raw), F.lit("\n")), F.lit("put everything on one line")))
        none = F.lit(None).cast("string")

        def fixes(items: Column) -> Column:
            n = F.size(items)
            short = F.concat(F.slice(items, 1, MOST_LISTED - 1), F.array(_number(n - (MOST_LISTED - 1), "other fix", "other fixes")))
            return F.when(n > 0, F.concat(F.lit("Fixed "), listed(F.when(n > MOST_LISTED, short).otherwise(items)), F.lit(".")))

        def actions(items: Column) -> Column:
            text = listed(items)
            return F.when(F.size(items) > 0, F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)), F.lit(".")))

        first = let(F.array_compact(F.array(*fixed, none)), fixes)
        second = let(F.array_compact(F.array(*acted, none)), actions)
        return F.array_compact(F.array(first, second))

    needed = [check for check, ops, *_ in CHARACTER_FIXES + STRUCTURE_FIXES if on & set(ops.split())]
    sentences = let(counts_of(raw, needed), lambda was: let(counts_of(F.coalesce(after, F.lit("")), needed), lambda now: told(was, now)))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(sentences)


#: Why joining lines is suggested (fixed wording).
REASONS = (
    ("hardWrap hyphenBreaks", "Some lines break in the middle of a sentence, as they do when copied from a PDF or an email."),
    ("pageNumbers runningHeads", "This looks like it has page numbers or repeated headers from a PDF."),
    ("emailQuoting", "This has email reply markers (>) at the start of lines."),
)
SUGGESTION = "struct<id:string,text:string,button:string,option:string>"


def suggestions(t: Column, options: CleanOptions | dict | None = None) -> Column:
    """What else might help, as an array of (id, text, button, option)."""
    given = CleanOptions.of(options)
    raw = repair.newlines(F.coalesce(t, F.lit("")))
    offers = []

    def offer(when: Column, name: str, text: Column, button: str) -> Column:
        made = F.struct(F.lit(name).alias("id"), text.alias("text"), F.lit(button).alias("button"), F.lit(name).alias("option"))
        return F.when(when, made)

    if not (given.joinLines or given.oneLine):

        def reason(found: Column) -> Column:
            out = F.lit(None).cast("string")
            for checks, text in reversed(REASONS):
                any_of = F.lit(False)
                for check in checks.split():
                    any_of = any_of | (found[check] > 0)
                out = F.when(any_of, F.lit(text)).otherwise(out)
            return out

        names = [c for checks, _ in REASONS for c in checks.split()]
        offers.append(let(let(counts_of(raw, names), reason), lambda r: offer(r.isNotNull(), "joinLines", r, "Join broken lines")))
    if not given.stripHtml:
        offers.append(offer(markup.looks_like_html(raw), "stripHtml", F.lit("This contains HTML tags."), "Strip HTML"))
    empty = F.array().cast(f"array<{SUGGESTION}>")
    if not offers:
        return empty
    return F.when(raw.rlike(chars.NOT_WS), F.array_compact(F.array(*offers))).otherwise(empty)

"""The operations by id, in the order in which a pipeline runs them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from textloom.functions import casing, encoding, linewise, markup, repair, replace, spacing, typography
from textloom.operators.wording import OPERATION_LABELS

GROUPS = ("markup", "repair", "typography", "structure", "spacing", "replace", "case", "format")


@dataclass(frozen=True)
class Op:
    """``params`` maps a parameter to its default. Ops of one ``exclusive`` group do not go together."""

    id: str
    group: str
    run: Callable[..., Column]
    default: bool = False
    exclusive: str | None = None
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        """What users call it; operations added later go by their id."""
        return OPERATION_LABELS.get(self.id, self.id)


_NO_RULES = ({"find": "", "replace": ""},)
_REPLACE = {"rules": _NO_RULES, "regex": False, "matchCase": False, "wholeWord": False}

OPS: dict[str, Op] = {
    op.id: op
    for op in (
        Op("htmlToText", "markup", markup.html_to_text, exclusive="markup", params={"keepStructure": True, "keepLinks": False, "listMarker": "- "}),
        Op("stripTags", "markup", markup.strip_tags, exclusive="markup", params={"decode": True}),
        Op("htmlToMarkdown", "markup", markup.html_to_markdown, exclusive="markup"),
        Op("stripMarkdown", "markup", markup.strip_markdown),
        Op("decodeEntities", "markup", markup.decode_entities),
        Op("encodeEntities", "markup", markup.encode_entities, params={"all": False}),
        Op("fixMojibake", "repair", repair.fix_mojibake, default=True),
        Op("fixCp1252", "repair", repair.fix_cp1252, default=True),
        Op("normaliseUnicode", "repair", repair.normalise_unicode, default=True, params={"form": "NFC"}),
        Op("removeInvisibles", "repair", repair.remove_invisibles, default=True),
        Op("removeControls", "repair", repair.remove_controls, default=True, params={"privateUse": True}),
        Op("normaliseSpaces", "repair", repair.normalise_spaces, default=True),
        Op("expandLigatures", "repair", repair.expand_ligatures, default=True),
        Op("transliterate", "repair", repair.transliterate),
        Op("removeEmoji", "repair", repair.remove_emoji),
        Op("asciiOnly", "repair", repair.ascii_only, params={"replacement": ""}),
        Op("straightenQuotes", "typography", typography.straighten_quotes, default=True, exclusive="quotes"),
        Op("curlQuotes", "typography", typography.curl_quotes, exclusive="quotes"),
        Op("straightenDashes", "typography", typography.straighten_dashes, default=True, exclusive="dashes"),
        Op("typographicDashes", "typography", typography.typographic_dashes, exclusive="dashes"),
        Op("asciiSymbols", "typography", typography.ascii_symbols),
        Op("cleanUrls", "typography", typography.clean_urls),
        Op("removeEmailQuoting", "structure", linewise.remove_email_quoting, params={"dropQuotedText": False}),
        Op("removeListMarkers", "structure", linewise.remove_list_markers, exclusive="listMarkers", params={"bullets": True, "numbers": True}),
        Op("normaliseListMarkers", "structure", linewise.normalise_list_markers, exclusive="listMarkers", params={"marker": "- "}),
        Op("removePageNumbers", "structure", linewise.remove_page_numbers),
        Op("removeRepeatedLines", "structure", linewise.remove_repeated_lines, params={"minOccurrences": 3}),
        Op("dehyphenate", "structure", linewise.dehyphenate),
        Op("unwrapParagraphs", "structure", linewise.unwrap_paragraphs, exclusive="lineBreaks", params={"dehyphenate": True}),
        Op("removeAllLineBreaks", "structure", linewise.remove_all_line_breaks, exclusive="lineBreaks", params={"separator": " "}),
        Op("removeEmptyLines", "structure", linewise.remove_empty_lines, exclusive="blankLines"),
        Op("collapseBlankLines", "structure", linewise.collapse_blank_lines, default=True, exclusive="blankLines", params={"max": 1}),
        Op("doubleSpaceLines", "structure", linewise.double_space_lines, exclusive="blankLines"),
        Op("deduplicateLines", "structure", linewise.deduplicate_lines, params={"caseSensitive": False, "adjacentOnly": False}),
        Op("filterLines", "structure", linewise.filter_lines, params={"pattern": "", "mode": "keep", "regex": False, "ignoreCase": True}),
        Op("sortLines", "structure", linewise.sort_lines, params={"order": "asc", "ignoreCase": True}),
        Op("tabsToSpaces", "spacing", spacing.tabs_to_spaces, exclusive="tabs", params={"width": 4}),
        Op("spacesToTabs", "spacing", spacing.spaces_to_tabs, exclusive="tabs", params={"width": 4}),
        Op("collapseSpaces", "spacing", spacing.collapse_spaces, default=True),
        Op("trimLines", "spacing", spacing.trim_lines, default=True, params={"end": True, "start": True}),
        Op("fixSpaceBeforePunctuation", "spacing", spacing.space_before_punctuation, default=True),
        Op("fixSpaceAfterPunctuation", "spacing", spacing.space_after_punctuation),
        Op("sentenceSpacing", "spacing", spacing.sentence_spacing, params={"mode": "single"}),
        Op("findReplace", "replace", replace.replace_rules, params=_REPLACE),
        Op("removeCharacters", "replace", replace.remove_characters, params={"characters": ""}),
        Op("removePunctuation", "replace", replace.remove_punctuation, params={"keep": ".,'"}),
        Op("removeNumbers", "replace", replace.remove_numbers),
        Op("extract", "replace", replace.extract, params={"pattern": "urls", "unique": True, "sort": False}),
        Op("changeCase", "case", casing.change_case, params={"mode": "sentence", "preserveAcronyms": True}),
        Op("wrapLines", "format", linewise.wrap_lines, params={"width": 80, "breakLongWords": False}),
        Op("affixLines", "format", linewise.affix_lines, params={"prefix": "", "suffix": "", "skipEmpty": True}),
        Op("numberLines", "format", linewise.number_lines, exclusive="numbering", params={"start": 1, "separator": ". ", "pad": False}),
        Op("removeLineNumbers", "format", linewise.remove_line_numbers, exclusive="numbering"),
        Op("joinLines", "format", linewise.join_lines, params={"separator": ", ", "quote": ""}),
        Op("splitToLines", "format", linewise.split_to_lines, params={"separator": ","}),
        Op("reverse", "format", linewise.reverse, params={"mode": "lines"}),
        Op("encode", "format", encoding.encode, params={"mode": "urlEncode"}),
        Op("trimDocument", "format", spacing.trim_document, default=True),
    )
}


def default_params() -> dict[str, dict]:
    return {i: dict(op.params) for i, op in OPS.items() if op.params}


def default_enabled() -> list[str]:
    return [i for i, op in OPS.items() if op.default]


def conflicts_with(op_id: str, enabled) -> list[str]:
    """Enabled ops of the same exclusive group: reported, not enforced."""
    group = OPS[op_id].exclusive if op_id in OPS else None
    return [i for i in OPS if group and i in enabled and i != op_id and OPS[i].exclusive == group]


def register_op(op: Op) -> None:
    """Add an operation; it runs after those of the registry."""
    if op.group not in GROUPS or op.id in OPS:
        raise ValueError(f"group {op.group!r} is unknown or id {op.id!r} is taken")
    OPS[op.id] = op

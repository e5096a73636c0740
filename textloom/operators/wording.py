"""Wording that results carry."""

# Labels and explanations as users of these checks and operations know them.

CHECK_LABELS = {
    "mojibake": "Garbled characters",
    "replacementChar": "Replacement characters",
    "tagChars": "Invisible tag characters",
    "bidi": "Bidirectional overrides",
    "html": "HTML markup",
    "hardWrap": "Hard-wrapped paragraphs",
    "hyphenBreaks": "Words split by a hyphen",
    "invisibles": "Invisible characters",
    "controls": "Control characters",
    "objects": "Image and object placeholders",
    "privateUse": "Private-use glyphs",
    "nbsp": "Non-breaking and exotic spaces",
    "ligatures": "Typographic ligatures",
    "entities": "HTML entities",
    "emailQuoting": "Email reply markers",
    "pageNumbers": "Stray page numbers",
    "runningHeads": "Repeating running heads",
    "smartQuotes": "Curly quotes and apostrophes",
    "dashes": "En and em dashes",
    "bullets": "Bullet characters",
    "duplicateLines": "Duplicate lines",
    "multiSpace": "Repeated spaces",
    "trailingSpace": "Trailing whitespace",
    "tabs": "Tabs",
    "blankRuns": "Runs of blank lines",
    "spaceBeforePunctuation": "Space before punctuation",
    "trackingLinks": "URLs with tracking parameters",
    "emoji": "Emoji and pictographs",
}
#: Checks without an explanation have none here.
CHECK_DETAILS = {
    "mojibake": "Text that was encoded twice somewhere upstream. The worst kind, because it looks like real characters and survives everything else.",
    "replacementChar": "The original character is already lost. Worth going back to the source before using this text.",
    "tagChars": "Invisible code points sometimes used to watermark or fingerprint text.",
    "bidi": "Invisible characters that reorder how text displays, so it can read differently from how it is stored.",
    "html": "Tags came across with the text.",
    "hardWrap": "Line breaks in the middle of sentences, from a PDF column or a plain-text email.",
    "hyphenBreaks": "A word broken across a line break by PDF hyphenation.",
    "invisibles": "Zero-width spaces, soft hyphens and byte order marks. They break search, sorting and word counts.",
    "controls": "Non-printing characters that some applications refuse to import.",
    "objects": "Left where an image, chart or embedded object used to be.",
    "privateUse": "Font-specific characters, usually Word or InDesign bullets. They render as empty boxes anywhere else.",
    "nbsp": "They look like spaces but do not wrap, do not match a space in search, and confuse layout software.",
    "ligatures": "PDF extraction glyphs. Searching for a word will not match it when two of its letters are one character.",
    "entities": "Escaped characters that should be real ones.",
    "emailQuoting": "Lines prefixed with the marker a mail client adds to a quoted reply.",
    "pageNumbers": "Lines containing nothing but a page number.",
    "runningHeads": "Short lines that appear again and again, usually a header or footer.",
    "smartQuotes": "Correct in a document, a problem in code, CSVs, URLs and search boxes.",
    "dashes": "Often arrive unspaced, which reads as a compound word once flattened.",
    "bullets": "A real list arrived as text beginning with a bullet glyph.",
    "multiSpace": "Runs of two or more spaces in the middle of a line.",
    "tabs": "Fine in code, unpredictable in a document or a form field.",
}
OPERATION_LABELS = {
    "htmlToText": "Strip HTML",
    "stripTags": "Strip tags only",
    "htmlToMarkdown": "HTML to Markdown",
    "stripMarkdown": "Strip Markdown",
    "decodeEntities": "Decode HTML entities",
    "encodeEntities": "Encode HTML entities",
    "fixMojibake": "Repair mojibake",
    "fixCp1252": "Repair Windows-1252 bytes",
    "normaliseUnicode": "Normalise Unicode (NFC)",
    "removeInvisibles": "Remove invisible characters",
    "removeControls": "Remove control characters",
    "normaliseSpaces": "Convert non-breaking spaces",
    "expandLigatures": "Expand ligatures",
    "transliterate": "Remove accents",
    "removeEmoji": "Remove emoji",
    "asciiOnly": "ASCII only",
    "straightenQuotes": "Straighten quotes",
    "curlQuotes": "Smarten quotes",
    "straightenDashes": "Straighten dashes",
    "typographicDashes": "Smarten dashes",
    "asciiSymbols": "Spell out symbols",
    "cleanUrls": "Strip tracking from URLs",
    "removeEmailQuoting": "Remove email quote markers",
    "removeListMarkers": "Remove list markers",
    "normaliseListMarkers": "Normalise list markers",
    "removePageNumbers": "Remove page numbers",
    "removeRepeatedLines": "Remove running heads and feet",
    "dehyphenate": "Rejoin hyphenated words",
    "unwrapParagraphs": "Remove line breaks (keep paragraphs)",
    "removeAllLineBreaks": "Remove all line breaks",
    "removeEmptyLines": "Remove empty lines",
    "collapseBlankLines": "Limit blank lines",
    "doubleSpaceLines": "Blank line between every line",
    "deduplicateLines": "Remove duplicate lines",
    "filterLines": "Keep or drop matching lines",
    "sortLines": "Sort lines",
    "tabsToSpaces": "Tabs to spaces",
    "spacesToTabs": "Leading spaces to tabs",
    "collapseSpaces": "Collapse repeated spaces",
    "trimLines": "Trim each line",
    "fixSpaceBeforePunctuation": "Fix space before punctuation",
    "fixSpaceAfterPunctuation": "Add missing space after punctuation",
    "sentenceSpacing": "Sentence spacing",
    "findReplace": "Find and replace",
    "removeCharacters": "Remove specific characters",
    "removePunctuation": "Remove punctuation",
    "removeNumbers": "Remove digits",
    "extract": "Extract only",
    "changeCase": "Convert case",
    "wrapLines": "Wrap at column",
    "affixLines": "Add prefix or suffix",
    "numberLines": "Number the lines",
    "removeLineNumbers": "Remove line numbers",
    "joinLines": "Join lines with a delimiter",
    "splitToLines": "Split into lines",
    "reverse": "Reverse",
    "encode": "Encode or decode",
    "trimDocument": "Trim the whole document",
}

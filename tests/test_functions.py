"""Single operations against expected texts."""

import pytest

from textloom.functions import casing, encoding, linewise, markup, repair, replace, spacing, typography

FAMILY = "\U0001f468‍\U0001f469‍\U0001f467"
SCOTLAND = "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"

CASES = [
    (repair.newlines, {}, "a\r\nb\rc d e", "a\nb\nc\nd\ne"),
    (repair.fix_mojibake, {}, "caf\xc3\xa9", "caf\xe9"),
    (repair.fix_mojibake, {}, "it\xe2€™s 中", "it’s 中"),
    (repair.fix_mojibake, {}, "plain \xe9", "plain \xe9"),
    (repair.fix_mojibake, {}, "\xc3\xa9 and \xe9", "\xe9 and \xe9"),
    (repair.fix_cp1252, {}, "a\x92b\x81c\x80", "a’bc€"),
    (repair.normalise_unicode, {}, "é", "\xe9"),
    (repair.normalise_unicode, {"form": "NFKC"}, "ﬁ", "fi"),
    (repair.remove_invisibles, {}, f"a​b\xad{FAMILY}\U000e0041", f"ab{FAMILY}"),
    (repair.remove_invisibles, {}, SCOTLAND + "‍", SCOTLAND),
    (repair.remove_controls, {}, "a\x07b￼\tc", "ab\tc"),
    (repair.remove_controls, {"privateUse": False}, "a", "a"),
    (repair.normalise_spaces, {}, "a\xa0b　c", "a b c"),
    (repair.expand_ligatures, {}, "ﬁn oﬄ Ĳ", "fin offl IJ"),
    (repair.transliterate, {}, "\xc6r\xf8 stra\xdfe \xe9\xf1 €5", "AEro strasse en EUR5"),
    (repair.remove_emoji, {}, f"good\U0001f600day {FAMILY}! \xa9 ✔ ✔️ 1️⃣", "good day ! \xa9 ✔  "),
    (repair.ascii_only, {"replacement": "?"}, "a\xe9\U0001f600", "a???"),
    (repair.remove_bidi, {}, "a‮b", "ab"),
    (typography.straighten_quotes, {}, "“a” ‘b’ \xabc\xbb", "\"a\" 'b' \"c\""),
    (typography.curl_quotes, {}, "\"It's\" 'til '90s", "“It’s” ’til ’90s"),
    (typography.straighten_dashes, {}, "a—b—c 1–2", "a - b-c 1-2"),
    (typography.typographic_dashes, {}, "1 - 2 a -- b...", "1–2 a—b…"),
    (typography.ascii_symbols, {}, "… \xbd 5\xb0 →", "... 1/2 5 degrees ->"),
    (typography.clean_urls, {}, "see https://a.org/?utm_source=x&q=1#f, http://b.org/?gclid=1", "see https://a.org/?q=1#f, http://b.org/"),
    (linewise.remove_email_quoting, {}, "> > a\nb", "a\nb"),
    (linewise.remove_email_quoting, {"dropQuotedText": True}, "> a\nb", "b"),
    (linewise.remove_list_markers, {}, "• a\n  1) b\n- 1. c", "a\n  b\nc"),
    (linewise.normalise_list_markers, {}, "  • a\nb", "  - a\nb"),
    (linewise.remove_page_numbers, {}, "a\n 12 \n[3]\nPage 4 of 9\n5 / 6\nxiv\nmix\nb", "a\nb"),
    (linewise.remove_repeated_lines, {}, "H\na\nH \nb\n H\n\n", "a\nb\n\n"),
    (linewise.dehyphenate, {}, "exam-\n  ple X-\nray", "example X-\nray"),
    (linewise.unwrap_paragraphs, {}, "This is a line that was cut\nat a fixed width by some-\nthing that made it.\n\n- one\n- two", "This is a line that was cut at a fixed width by something that made it.\n\n- one\n- two"),
    (linewise.unwrap_paragraphs, {}, "HEADING HERE\nThis text follows the heading and runs on\nfor a while.", "HEADING HERE\nThis text follows the heading and runs on for a while."),
    (linewise.remove_all_line_breaks, {}, " a \n\n b", "a b"),
    (linewise.remove_empty_lines, {}, "a\n \xa0\n\nb", "a\nb"),
    (linewise.collapse_blank_lines, {}, "a\n\n\n\nb\n\nc", "a\n\nb\n\nc"),
    (linewise.collapse_blank_lines, {"max": 0}, "a\n\n\nb", "a\nb"),
    (linewise.double_space_lines, {}, "a\nb", "a\n\nb"),
    (linewise.deduplicate_lines, {}, "B\na\n\nA \nb\n\n", "B\na\n\n\n"),
    (linewise.deduplicate_lines, {"caseSensitive": True, "adjacentOnly": True}, "a\na\nb\na\n\n\n", "a\nb\na\n"),
    (linewise.keep_duplicate_lines, {}, "b\na\nb\nc\na\n\n", "b\na"),
    (linewise.filter_lines, {"pattern": "A"}, "a\nb\nca", "a\nca"),
    (linewise.filter_lines, {"pattern": "^a|b$", "regex": True, "mode": "drop"}, "ab\nc", "c"),
    (linewise.filter_lines, {"pattern": "(", "regex": True}, "a\nb", "a\nb"),
    (linewise.sort_lines, {}, "item 10\nItem 2\n\xe9clair\neat\nzoo", "eat\n\xe9clair\nItem 2\nitem 10\nzoo"),
    (linewise.sort_lines, {"order": "desc"}, "a\nc\nb", "c\nb\na"),
    (linewise.sort_lines, {"order": "length"}, "ccc\na\nbb", "a\nbb\nccc"),
    (linewise.sort_lines, {"order": "lengthDesc"}, "a\nccc\nbb", "ccc\nbb\na"),
    (linewise.sort_lines, {"order": "reverse"}, "a\nc\nb", "b\nc\na"),
    (linewise.wrap_lines, {"width": 12}, "  one two three four", "  one two\n  three four"),
    (linewise.wrap_lines, {"width": 10, "breakLongWords": True}, "ab abcdefghijklmnopqrstuvwxyz c", "ab\nabcdefghij\nklmnopqrst\nuvwxyz c"),
    (linewise.number_lines, {"pad": True}, "\n".join("abcdefghij"), "\n".join(f"{i:>2}. {c}" for i, c in enumerate("abcdefghij", 1))),
    (linewise.remove_line_numbers, {}, "1. a\n 22) b\nc 3", "a\nb\nc 3"),
    (linewise.affix_lines, {"prefix": "$1", "suffix": "\\"}, "a\n\nb", "$1a\\\n\n$1b\\"),
    (linewise.join_lines, {"quote": "'", "separator": ",\\n"}, " a \n\nb", "'a',\n'b'"),
    (linewise.split_to_lines, {}, "a, b,,c", "a\nb\n\nc"),
    (linewise.split_to_lines, {"separator": ""}, "a,b", "a,b"),
    (linewise.reverse, {}, "a\nb", "b\na"),
    (linewise.reverse, {"mode": "words"}, "a  b c\nd e", "c b  a\ne d"),
    (linewise.reverse, {"mode": "characters"}, "a\U0001f600b", "b\U0001f600a"),
    (spacing.tabs_to_spaces, {"width": 2}, "\ta", "  a"),
    (spacing.spaces_to_tabs, {}, "     a\n  b", "\t a\n  b"),
    (spacing.collapse_spaces, {}, "a \t b\tc", "a b\tc"),
    (spacing.trim_lines, {}, " a \n\tb\xa0", "a\nb"),
    (spacing.trim_lines, {"start": False}, " a ", " a"),
    (spacing.trim_document, {}, "﻿\n a \n", "a"),
    (spacing.space_before_punctuation, {}, "a , b ( c ) d ... e .", "a, b (c) d ... e."),
    (spacing.space_after_punctuation, {}, "a,b.C 1,000 d!)", "a, b. C 1,000 d!)"),
    (spacing.sentence_spacing, {}, "A.   B", "A. B"),
    (spacing.sentence_spacing, {"mode": "double"}, "A. B", "A.  B"),
    (spacing.space_before_units, {}, "5kg 10% 3cmx", "5 kg 10% 3cmx"),
    (replace.find_replace, {"find": "A.b", "replace": "$5"}, "xa.bx", "x$5x"),
    (replace.find_replace, {"find": "(\\w)\\s(\\w)", "replace": "$2$1$$\\n", "regex": True}, "a\xa0b", "ba$\n"),
    (replace.find_replace, {"find": "cat", "replace": "dog", "wholeWord": True}, "cat \xe9cat concat Cat", "dog \xe9dog concat dog"),
    (replace.find_replace, {"find": "(", "replace": "x", "regex": True}, "a(b", "a(b"),
    (replace.remove_characters, {"characters": "a-c]"}, "abcd]", "d"),
    (replace.remove_punctuation, {}, "a.b,c!d$e'f", "a.b,cde'f"),
    (replace.remove_numbers, {}, "a1b22", "ab"),
    (replace.extract, {"pattern": "emails"}, "x a@b.co, A@b.co a@b.co", "a@b.co\nA@b.co"),
    (replace.extract, {"pattern": "dates", "sort": True}, "on 2024-02-01 and 1/2/2023", "1/2/2023\n2024-02-01"),
    (replace.extract, {"pattern": "phones"}, "call +1 (555) 123-4567 now", "+1 (555) 123-4567"),
    (replace.extract, {"pattern": "hashtags"}, "#a #\xe9t\xe9 #", "#a\n#\xe9t\xe9"),
    (replace.extract, {"pattern": "nothing"}, "as is", "as is"),
    (casing.sentence, {}, "HELLO world. NASA said. i saw an iPhone", "HELLO world. NASA said. I saw an iPhone"),
    (casing.sentence, {"preserveAcronyms": False}, "HELLO World. next\nline", "Hello world. Next\nLine"),
    (casing.title, {}, "the lord of the rings: a tale of iPhone", "The Lord of the Rings: A Tale of iPhone"),
    (casing.capital, {}, "don't stop NASA", "Don't Stop NASA"),
    (casing.toggle, {}, "aBc\xe9 1", "AbC\xc9 1"),
    (casing.alternating, {}, "ab cd", "Ab Cd"),
    (casing.camel, {}, "hello bigWorld-42x", "helloBigWorld42x"),
    (casing.pascal, {}, "hello bigWorld", "HelloBigWorld"),
    (casing.slug, {}, " Caf\xe9 & Bar! ", "cafe-bar"),
    (casing.change_case, {"mode": "constant"}, "helloWorld foo", "HELLO_WORLD_FOO"),
    (casing.change_case, {"mode": "?"}, "hello. you", "Hello. You"),
    (encoding.url_encode, {}, "a b~!*'()\xe9", "a%20b~!*'()%C3%A9"),
    (encoding.url_decode, {}, "a%20b+%C3%A9", "a b \xe9"),
    (encoding.url_decode, {}, "100%", "100%"),
    (encoding.base64_encode, {}, "h\xe9" * 60, __import__("base64").b64encode(("h\xe9" * 60).encode()).decode()),
    (encoding.base64_decode, {}, " aMOp\n", "h\xe9"),
    (encoding.base64_decode, {}, "!!!", "!!!"),
    (encoding.json_escape, {}, 'a"\\\n\x1f/', 'a\\"\\\\\\n\\u001f/'),
    (encoding.json_unescape, {}, 'a\\u00e9 "b"\n', 'a\xe9 "b"\n'),
    (encoding.json_unescape, {}, "bad \\x", "bad \\x"),
    (encoding.csv_field, {}, 'a"b\nc', '"a""b c"'),
    (markup.html_to_text, {}, "<p>A &amp; <b>b</b></p><ul><li>x<li>y</ul><script>no</script><br>z", "A & b\n\n- x\n- y\n\nz"),
    (markup.html_to_text, {"keepLinks": True}, '<a href="http://a.org">here</a> <a href="#x">there</a>', "here (http://a.org) there"),
    (markup.html_to_text, {"keepStructure": False}, "<p>a</p><p>b</p>", "a b"),
    (markup.html_to_text, {}, "<!--[if mso]><p>x</p><![endif]--><o:p>a</o:p><table><tr><td>1</td><td>2</td></tr></table>", "a\n\n1 2"),
    (markup.strip_tags, {}, "<p>a</p>&lt;b", "a<b"),
    (markup.html_to_markdown, {}, '<h2>T</h2><p>a <strong>b</strong> <em>c</em> <a href="u">l</a></p><ul><li>x</li></ul>', "## T\n\na **b** _c_ [l](u)\n\n- x"),
    (markup.strip_markdown, {}, "# T\n**bold** `code` [l](u)\n- x\n| a | b |\n|---|---|", "T\nbold code l\nx\na\tb\n"),
    (markup.decode_entities, {}, "&amp;lt; &#8217; &#x41; &#146; &EACUTE; &nope; &#abc; &#12ab; &#1114112; &#xD800;", "&lt; ’ A ’ \xe9 &nope; &#abc; \x0c &#1114112; �"),
    (markup.encode_entities, {"all": True}, "<\xe9\U0001f600>", "&lt;&#233;&#55357;&#56832;&gt;"),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    """All cases in a few plans, not one each."""
    from pyspark.sql import functions as F

    out = {}
    for at in range(0, len(CASES), 12):
        part = CASES[at : at + 12]
        frame = spark.range(1).select(*[f(F.lit(text), **p).alias(f"c{at + i}") for i, (f, p, text, _) in enumerate(part)])
        out.update(frame.first().asDict())
    return out


@pytest.mark.parametrize("n", range(len(CASES)), ids=lambda n: f"{n}-{CASES[n][0].__name__}")
def test_case(outcomes, n):
    assert outcomes[f"c{n}"] == CASES[n][3]


def test_bad_range_is_an_error(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        replace.remove_characters(F.lit("x"), "z-a")


def test_sources_are_ascii():
    import glob
    import os

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{top}/textloom/**/*.py", recursive=True):
        with open(path, encoding="utf-8") as f:
            assert f.read().isascii(), path

"""Quality rules from repetition coverage.

Words of a slice of documents stand in one numpy array of 64-bit hashes; the rolling hash of n words extends that of n - 1
by one multiply-add. A window that occurs twice in its document marks its words, and the characters of marked words over
all word characters are the coverage for n. Repeated lines are measured alike. A document is kept unless a coverage is over
its limit or the base rules fail.

Limits are on characters, as in published web-corpus filters, for windows of ``LENGTHS`` words and for repeated lines; see
``DEFAULT``. They only count from ``MIN_WORDS`` words on, where a single repeat is no large share.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; texts are processed whole, a slice
holds one text at least, whatever its length; a row is a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from textloom.llm.common import map_rows

LENGTHS = (5, 6, 7, 8, 9, 10)
WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_HASHES = 400_000


@dataclass(frozen=True)
class Limits:
    """Most of the word characters that may lie in repeated windows of n words, and in repeated lines."""

    windows: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25})
    lines: float = 0.30


DEFAULT = Limits()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def repeated_windows(rolled: np.ndarray, doc: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n words whose hash occurs twice in their document. ``end``: where each word's document ends."""
    starts = np.flatnonzero(np.arange(len(rolled)) + n <= end[: len(rolled)])
    if len(starts) < 2:
        return starts[:0]
    # the document goes into the key, so one sort serves all
    key = rolled[starts] ^ (doc[starts] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    marked = np.zeros(len(starts), bool)
    marked[1:] |= same
    marked[:-1] |= same
    return np.sort(starts[order[marked]])


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside windows of n words at ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """For each text: counts of words, word characters, symbols, repeated lines, words in repeated windows, and coverages."""
    k = len(texts)
    out = {name: np.zeros(k, np.int64) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "line_chars")}
    hashes, chars, sizes = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        words = text.encode().split()
        sizes.append(len(words))
        hashes += map(_hashes.__getitem__, words)
        plain = text.isascii()
        chars += map(len, words) if plain else [len(w.decode()) for w in words]
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        seen, again, again_chars = set(), 0, 0
        for line in text.split("\n"):
            if line in seen:
                again += 1
                again_chars += sum(len(w.decode()) for w in line.encode().split())
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
        out["n_dup_lines"][i], out["line_chars"][i] = again, again_chars
    sizes = np.array(sizes, np.int64)
    total = int(sizes.sum())
    out["n_words"] = sizes
    h = np.array(hashes, np.uint64)
    chars = np.array(chars, np.int64)
    doc = np.repeat(np.arange(k, dtype=np.uint64), sizes)
    who = doc.astype(np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    out["word_chars"] = np.bincount(who, chars, k).astype(np.int64) if total else np.zeros(k, np.int64)
    rolled = h
    for n in range(2, max(*LENGTHS, WINDOW) + 1):
        if total < n:
            rolled = rolled[:0]
        else:
            rolled = rolled[: total - n + 1] * BASE + h[n - 1 :]
        if n in LENGTHS or n == WINDOW:
            inside = covered(repeated_windows(rolled, doc, end, n), n, total)
            if n == WINDOW:
                out["n_repeat_words"] = np.bincount(who, inside, k).astype(np.int64) if total else np.zeros(k, np.int64)
            if n in LENGTHS:
                out[f"chars_{n}"] = np.bincount(who, inside * chars, k).astype(np.int64) if total else np.zeros(k, np.int64)
    return out


def verdict(found: dict[str, np.ndarray], limits: Limits = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) by the counts of ``measure``."""
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 30 * found["n_words"])
    whole = np.maximum(found["word_chars"], 1)
    over = found["line_chars"] > limits.lines * whole
    for n, most in limits.windows.items():
        over |= found[f"chars_{n}"] > most * whole
    return failed, ~(failed | over)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rated(docs: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """doc_id, the counts, coverages by window length and line, base_failed, kept: one pass, no shuffle."""
    names = [*COUNTS, "line_chars", *(f"chars_{n}" for n in LENGTHS)]

    def make():
        def run(c):
            found = measure(c["text"])
            failed, kept = verdict(found, limits)
            return {"doc_id": c["doc_id"]} | {n: found[n].tolist() for n in names} | {"base_failed": failed.tolist(), "kept": kept.tolist()}

        return run

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean", make, 4 << 20)


def digest(docs: DataFrame) -> DataFrame:
    return rated(docs).select("doc_id", *COUNTS, "base_failed", "kept")

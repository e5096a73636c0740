"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into the longest pieces that
occur in that text; few pieces mean that the language's text explains it. The count, times log2 of the training length and
divided by the characters parsed, is the cross-parsing entropy; the language with the least wins.

The automata become one displaced table: the edges of a state lie at its base plus the letter's column, in slots that no
other state uses, so its size follows the edges (three a training letter at most) and not states times letters, and numpy
parses many segments of ``SEGMENT`` characters against all languages at once. Whole texts are parsed; a segment starts a new
piece, which adds one piece to ``SEGMENT`` characters for every language.

Training takes ``TRAIN_DOCS`` documents with a letter a language at most (least hashes of the id first) and ``TRAIN_CHARS``
characters of each language's text, shared evenly by its documents: the bounds of the model, whatever the corpus. Each
language keeps all of its own text, however little another has, and its pieces cost log2 of its own letters, but never less
than log2 of ``LEAST_LETTERS``: a handful of letters would otherwise make pieces so cheap that they win every text. The table
is rebuilt by each worker from that text.

A verdict turns a text away whose entropy is over ``REJECT_BITS`` (text of a learned language needs 2 to 4 bits a character,
of another one about 5 or more, random letters 8), with ``SPARE_PIECES`` pieces more for the chances of short texts. Little
training text explains little: a language's limit is at least ``REJECT_RATIO`` times the entropy of one half of its training
text against the other half. With nothing to learn from, only texts without a letter are turned away.
A wrong label among the training texts is learned like a right one.

Defined cases: null texts and texts without a letter give ``und`` with score 0; ties take the language first in code-point
order; null languages and texts never train; with nothing to learn from, every text is ``und``; a row is a document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_rows, one_model

TRAIN_DOCS = 64
TRAIN_CHARS = 30_000
LEAST_LETTERS = 1_000
SEGMENT = 4096
REJECT_BITS = 4.6
REJECT_RATIO = 1.25
SPARE_PIECES = 6
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of anything but letters is one 32; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter()[codes]
    if not is_letter.any():
        return codes[:0]
    out = np.where(is_letter, codes, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return out[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


def displaced(edges: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base by state, owner by slot, target by slot): the edge of state s for column c lies at slot base[s] + c, which s then owns.

    States with most edges come first, each at the first base after the last one's where all its slots are free; those with
    one edge fill the gaps.
    """
    many = sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: (-len(edges[s]), s))
    single = np.array([s for s, e in enumerate(edges) if len(e) == 1], np.int64)
    base = np.zeros(len(edges), np.int64)
    used: set[int] = set()
    at = width - 1
    for s in many:
        columns = list(edges[s])
        at += 1
        while not used.isdisjoint([at + c for c in columns]):
            at += 1
        base[s] = at
        used.update(at + c for c in columns)
    size = max(used, default=width) + 1 + len(single) + width
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for s in many:
        for c, to in edges[s].items():
            owner[base[s] + c], target[base[s] + c] = s, to
    slots = np.flatnonzero(owner[width:] < 0)[: len(single)] + width
    owner[slots], target[slots] = single, [next(iter(edges[s].values())) for s in single]
    base[single] = slots - np.array([next(iter(edges[s])) for s in single], np.int64)
    if size >= 1 << 31:
        raise ValueError("the automata do not fit 32 bits")
    return base.astype(np.int32), owner, target


class Parser:
    """All languages' automata in one table. ``model``: language -> training text, of any length."""

    def __init__(self, model: dict[str, str]):
        self.languages = sorted(model, key=str.encode)
        texts = {k: letters(model[k]) for k in self.languages}
        alphabet = np.unique(np.concatenate([np.array([32], np.uint32), *texts.values()]))
        self.width = len(alphabet) + 1  # the last column: letters never met
        self.column = np.full(0x110000, len(alphabet), np.int32)
        self.column[alphabet] = np.arange(len(alphabet))
        self.bits = np.log2([max(len(texts[k]), LEAST_LETTERS) for k in self.languages])  # a piece, by language
        edges: list[dict[int, int]] = []
        self.starts = []
        # by language and column: the state after a piece's first letter; a letter never met is a piece and leads to the start
        self.first = np.zeros((max(len(self.languages), 1), self.width), np.int32)
        for n, k in enumerate(self.languages):
            go, at = suffix_automaton(self.column[texts[k]].tolist()), len(edges)
            self.starts.append(at)
            self.first[n] = at
            for c, to in go[0].items():
                self.first[n, c] = at + to
            edges += [{c: at + to for c, to in e.items()} for e in go]
        self.base, self.owner, self.target = displaced(edges, self.width)

    def pieces(self, columns: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): pieces that the greedy parse needs."""
        owner, lanes = [], []
        for i, x in enumerate(columns):
            for at in range(0, len(x), SEGMENT):
                lanes.append(x[at : at + SEGMENT])
                owner.append(i)
        out = np.zeros((len(columns), len(self.languages)))
        if not lanes:
            return out
        order = sorted(range(len(lanes)), key=lambda k: -len(lanes[k]))
        size = np.array([len(lanes[k]) for k in order])
        block = np.zeros((SEGMENT, len(lanes)), np.int32)
        for n, k in enumerate(order):
            block[: len(lanes[k]), n] = lanes[k]
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(lanes), 1)
        cost = np.ones(state.shape, np.int32)  # the piece that the segment ends in
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t
            letter, now = block[t, :n], state[:, :n]
            slot = self.base[now] + letter
            goes = self.owner[slot] == now
            cost[:, :n] += ~goes
            state[:, :n] = np.where(goes, self.target[slot], self.first[:, letter])
        who = np.array([owner[k] for k in order])
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(who, cost[k], len(columns))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (0.5: no better than the next language; 1: far better) and entropy in bits a character, for each text."""
        found = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        n = np.array([len(x) for x in found])
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rate = self.pieces([self.column[x] for x in found]) * self.bits / np.maximum(n, 1)[:, None]
        best = rate.argmin(1)
        least = rate.min(1)
        rest = rate.copy()
        rest[np.arange(len(n)), best] = np.inf
        second = rest.min(1) if len(self.languages) > 1 else np.full(len(n), np.inf)
        score = np.where(np.isinf(second), 1.0, 1 - least / np.maximum(least + np.where(np.isinf(second), 0, second), 1e-12))
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)],
            [float(s) if k else 0.0 for s, k in zip(score, n, strict=True)],
            [float(r) if k else 0.0 for r, k in zip(least, n, strict=True)],
        )

    def verdicts(self, texts: list[str | None], limit: dict[str, float]) -> list[str | None]:
        """The language of each text, ``und`` if there is none to choose from; None for one to turn away. ``limit``: by ``limits``."""
        if not self.languages:
            return [UNKNOWN if t and len(letters(t)) else None for t in texts]
        spare = {k: SPARE_PIECES * b for k, b in zip(self.languages, self.bits, strict=True)}
        lang, _, bits = self.predict(texts)
        return [k if k != UNKNOWN and (b <= limit[k] or (b - limit[k]) * len(letters(t)) <= spare[k]) else None for t, k, b in zip(texts, lang, bits, strict=True)]


def limits(model: dict[str, str]) -> dict[str, float]:
    """The most bits a character that a text of each language may need."""
    out = {}
    for k, text in model.items():
        half = len(text) // 2
        out[k] = max(REJECT_BITS, REJECT_RATIO * Parser({k: text[:half]}).predict([text[half:]])[2][0])
    return out


def held_out() -> F.Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def shared_out(sizes: list[int], total: int) -> list[int]:
    """What each of ``sizes`` gives to ``total``: the same from all, short ones all they have, the others what those leave."""
    out, left = [0] * len(sizes), total
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for n, i in enumerate(order):
        out[i] = min(sizes[i], left // (len(order) - n))
        left -= out[i]
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """language -> training text. Ids are chosen among texts with a letter; then only the chosen texts are collected."""
    # a long text is decoded whole only where its start has no letter
    letter = F.substring("text", 1, 100).rlike(r"\p{L}") | F.col("text").rlike(r"\p{L}")
    given = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & letter)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = given.select("doc_id", "lang").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= train_docs)
    ids = sorted({r["doc_id"] for r in chosen.select("doc_id").collect()})
    if not ids:
        return {}
    rows = given.filter(F.col("doc_id").isin(ids)).select("doc_id", "lang", F.substring("text", 1, train_chars).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    out = {}
    for k, all_texts in texts.items():
        shares = shared_out([len(t) for t in all_texts], train_chars)  # of each document: many voices
        joined = "\n".join(t[:n] for t, n in zip(all_texts, shares, strict=True))
        if len(letters(joined)):
            out[k] = joined
    return out


def parser(model: dict[str, str]) -> Parser:
    """One a worker and model."""
    return one_model(("language", *sorted(model.items())), lambda: Parser(model))


def predict(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    """doc_id, held_out, text hash, lang_pred, score, bits a character."""

    def make():
        p = parser(model)

        def run(c):
            lang, score, bits = p.predict(c["text"])
            return {k: v for k, v in c.items() if k != "text"} | {"lang_pred": lang, "score": score, "bits": bits}

        return run

    given = docs.select("doc_id", held_out().alias("held_out"), F.xxhash64("text").alias("thash"), "text")
    return map_rows(given, "doc_id long, held_out boolean, thash long, lang_pred string, score double, bits double", make, 8 << 20)


def identified(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, all columns; ``lang`` becomes the language found, if any was learned. One pass, no shuffle."""
    limit = limits(model)

    def run(batches):
        import pyarrow as pa

        p = parser(model)
        for batch in batches:
            names = batch.schema.names
            texts, place = batch.column(names.index("text")), names.index("lang")
            for at in range(0, batch.num_rows, 1024):
                found = p.verdicts(texts.slice(at, 1024).to_pylist(), limit)
                part = batch.slice(at, 1024)
                if model:
                    columns = part.columns
                    columns[place] = pa.array(found, batch.schema.field(place).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield part.filter(pa.array([k is not None for k in found]))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")

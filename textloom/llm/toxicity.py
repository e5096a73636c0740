"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (``GRAMS``, with marks at both ends) and itself, each hashed to a row of an
embedding table; a text is the mean of its words. Embeddings and the softmax are trained together by mini-batch Adam.
Misspellings share n-grams with the word they come from. The model is linear after the mean, so a trained word is one
number, kept in a bounded table per worker, and a text is one lookup a word.

Long texts dilute few bad words, so a text is scored by its windows of ``SPAN`` words, one at every word (a shorter text is
one window), and the highest window counts, a run of one word counting once: where a passage lies makes no difference.
Training averages over such windows too, the model taking for each toxic document the window it finds worst, at any word,
refreshed each epoch. Window sums are differences of running sums in fixed point (``UNIT``), so they are exact.

Training takes at most ``TRAIN_DOCS`` labelled rows of each label (least hashes of the id first, ties by id), and of these as
many as have ``TRAIN_CHARS`` characters together, whole texts, one at least: the model's bounds. Nothing else of the corpus
reaches the driver.

Defined cases: null or empty texts score as the model scores no words; a label null or a label without a document never
trains; documents labelled both ways count as toxic; with one label only, every score is that label; with none, 0; windows
that tie count once; repeated rows get equal scores, one each.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_rows
from textloom.llm.language_id import held_out

TRAIN_DOCS = 1500
TRAIN_CHARS = 5_000_000
BUCKETS = 1 << 15
DIM = 6
GRAMS = (3, 4, 5)
SPAN = 48
UNIT = 2.0**30
EPOCHS = 6
#: Small training sets run more epochs, until so many steps are made, at most ten times as many.
STEPS = 150
MAX_WORDS = 600_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def subwords(word: str) -> list[int]:
    """Rows of the word's bag."""
    marked = f"<{word}>"
    last = len(marked) + 1
    return [zlib.crc32(marked.encode()) % BUCKETS, *(zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(last - n))]


def window_means(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, means) of the windows at every word of texts that lie one after another: text i has ``sizes[i]`` words from ``first[i]``.

    ``once``: whether a word differs from the one before it; the first of a window always counts.
    """
    many = np.maximum(sizes - SPAN, 0) + 1
    at = np.cumsum(many) - many
    starts = np.arange(many.sum()) + np.repeat(first - at, many)
    ends = starts + np.repeat(np.minimum(sizes, SPAN), many)
    fixed = np.rint(values * UNIT).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(fixed * once)])
    counts = np.concatenate([[0], np.cumsum(once.astype(np.int64))])
    again = ~once[starts]
    total = sums[ends] - sums[starts] + fixed[starts] * again
    count = counts[ends] - counts[starts] + again
    # windows of a few words lean on the mean of SPAN / 4 words at least
    return starts, total / UNIT / np.maximum(count, SPAN // 4)


class Model:
    """``value``: for each bucket its embedding times the softmax's difference of classes; ``bias`` likewise."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.known = value, bias, {}  # an infinite bias: one label for all
        self.listed = value.tolist()

    def word(self, word: str) -> float:
        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        rows = subwords(word)
        v = self.known[word] = sum(map(self.listed.__getitem__, rows)) / len(rows)
        return v

    def logits(self, texts: list[str | None]) -> list[float]:
        """The highest window's logit for each text."""
        known, word, values, first, owner = self.known, self.word, [], [], []
        for i, text in enumerate(texts):
            at = len(values)
            values += [known[w] if w in known else word(w) for w in words_of(text)]
            if len(values) > at:
                first.append(at)
                owner.append(i)
        out = np.full(len(texts), -np.inf)
        if first:
            v, begin = np.array(values), np.array(first)
            sizes = np.diff(np.append(begin, len(v)))
            once = np.ones(len(v), bool)  # a run of one word counts once
            once[1:] = v[1:] != v[:-1]
            _, means = window_means(v, begin, sizes, once)
            many = np.maximum(sizes - SPAN, 0) + 1
            out[owner] = np.maximum.reduceat(means, np.cumsum(many) - many)
        out[np.isinf(out)] = 0.0
        return (out + self.bias).tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        if np.isinf(self.bias):
            return [float(self.bias > 0)] * len(texts)
        return (1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))).tolist()


def single(toxic: bool) -> Model:
    """The model where one label is known, or none."""
    return Model(np.zeros(BUCKETS), np.inf if toxic else -np.inf)


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax. Deterministic."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    flat_rows, size = array("H"), array("I")  # the bags of all words, one after another
    windows, doc_of, all_ids, texts_at, cells = [], [], [], [], []
    for i, text in enumerate(texts):
        ids = []
        for w in words_of(text):
            if w not in vocab:
                vocab[w] = len(vocab)
                bag = subwords(w)
                flat_rows.extend(bag)
                size.append(len(bag))
            if not ids or ids[-1] != vocab[w]:
                ids.append(vocab[w])
        base, last = len(all_ids), max(len(ids) - SPAN, 0)
        # a cell for each SPAN words: the window at its first word, and the places where its worst one may stand
        for at in range(0, len(ids), SPAN):
            windows.append(np.array(ids[at : at + SPAN]))
            doc_of.append(i)
            cells.append((base + min(at, last), base + min(at + SPAN, last + 1), base + len(ids)))
        if ids:
            texts_at.append((base, len(ids)))
            all_ids += ids
    label = np.array(toxic)
    if not windows or label.min() == label.max():
        return single(bool(len(label)) and label.min() == 1)
    doc_of, all_ids = np.array(doc_of), np.array(all_ids)
    begin, sizes = np.array(texts_at).T
    once = np.ones(len(all_ids), bool)
    size, flat = np.array(size, np.int64), np.frombuffer(flat_rows, np.uint16)
    first = np.concatenate([[0], np.cumsum(size)])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    moments = [np.zeros_like(p) for p in (emb, out, bias) for _ in range(2)]
    step = 0
    clean = np.flatnonzero(label[doc_of] == 0)
    for epoch in range(10 * epochs):
        if epoch >= epochs and step >= STEPS:
            break
        # what each word says by itself: the model is linear, so numbers do
        lean = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[flat], first[:-1]) / size
        starts, means = window_means(lean[all_ids], begin, sizes, once)
        at_word = np.full(len(all_ids), -np.inf)
        at_word[starts] = means
        place = np.array([lo + at_word[lo:hi].argmax() for lo, hi, _ in cells])  # the worst window of each cell
        score = at_word[place]
        worst = [all_ids[p : min(p + SPAN, end)] for p, (*_, end) in zip(place, cells, strict=True)]
        # of each toxic document the worst window (at first: all), of clean ones as many windows, the worst and others by chance
        if epoch < 2:
            bad = np.flatnonzero(label[doc_of] == 1)
        else:
            order = np.lexsort((-score, doc_of))
            bad = order[np.concatenate([[True], np.diff(doc_of[order]) > 0])]
            bad = bad[label[doc_of[bad]] == 1]
        hard = clean[np.argsort(-score[clean], kind="stable")[: len(bad) // 2]]
        # below len(windows): the cell's first window; from there on: its worst
        moved = len(windows) if epoch >= 2 else 0
        chosen = np.concatenate([bad + moved, hard + len(windows), rng.choice(clean, min(len(clean), 2 * len(bad)), replace=False)])
        both = windows + worst
        rng.shuffle(chosen)
        for at in range(0, len(chosen), 256):
            batch = chosen[at : at + 256]
            count = np.array([len(both[b]) for b in batch])
            words, back = np.unique(np.concatenate([both[b] for b in batch]), return_inverse=True)
            g_size = size[words]
            g = np.concatenate([flat[first[w] : first[w + 1]] for w in words])
            vec = np.add.reduceat(emb[g], np.concatenate([[0], np.cumsum(g_size)[:-1]])) / g_size[:, None]
            scale = 1 / np.maximum(count, SPAN // 4)
            mean = np.add.reduceat(vec[back], np.concatenate([[0], np.cumsum(count)[:-1]])) * scale[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = label[doc_of[batch % len(windows)]]
            p[np.arange(len(batch)), y] -= 1
            p /= len(batch)
            d_mean = (p @ out.T) * scale[:, None]
            d_word = np.zeros_like(vec)
            np.add.at(d_word, back, np.repeat(d_mean, count, 0))
            rows, slot = np.unique(g, return_inverse=True)
            d_emb = np.zeros((len(rows), DIM))
            np.add.at(d_emb, slot, np.repeat(d_word / g_size[:, None], g_size, 0))
            step += 1
            for k, (param, at_rows, grad, rate) in enumerate(((emb, rows, d_emb, 0.05), (out, slice(None), mean.T @ p, 0.02), (bias, slice(None), p.sum(0), 0.02))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m[at_rows] = 0.9 * m[at_rows] + 0.1 * grad
                v[at_rows] = 0.999 * v[at_rows] + 0.001 * grad**2
                param[at_rows] -= rate * (m[at_rows] / (1 - 0.9**step)) / (np.sqrt(v[at_rows] / (1 - 0.999**step)) + 1e-8)
    return Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Fit on rows whose id's crc32 is not divisible by 5. Only ids and labels are compared; chosen texts alone are read."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = docs.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))
    known = known.join(sizes, "doc_id").select("doc_id", "toxic", "size")
    toxic: dict[int, int] = {}
    for label in (0, 1):
        # the first rows of each task, then of those: no task holds all rows of a label
        first, chars = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect(), 0
        for n, r in enumerate(first):
            chars += r["size"]
            if n and chars > train_chars:
                break
            toxic[r["doc_id"]] = label
    if len(set(toxic.values())) < 2:
        return single(1 in toxic.values())
    rows = docs.filter(F.col("doc_id").isin(sorted(toxic)) & F.col("text").isNotNull()).select("doc_id", "text").collect()
    rows = sorted({(r["doc_id"], r["text"]) for r in rows})
    return fit([t for _, t in rows], [toxic[i] for i, _ in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one pass, no shuffle; the model (a few hundred KB, fixed) goes along."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))

    def make():
        own = Model(*shipped.value)

        def run(c):
            score = own.scores(c["text"])
            return {"doc_id": c["doc_id"], "held_out": c["held_out"], "score": score, "predicted": [int(s >= 0.5) for s in score]}

        return run

    given = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_rows(given, "doc_id long, held_out boolean, score double, predicted int", make, 4 << 20)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))

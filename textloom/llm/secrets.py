"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values long or mixed enough to be a key, and values given to a name that sounds like one. Features: length,
share of digits, capitals and symbols, entropy, mean log-probability of character transitions (of prose), share covered by
dictionary words, whether it looks like a path, address or number, a fixed prefix of known key formats, and the words next
to it. The forest is trained in numpy on labelled findings: (before, value, after, label) rows. Those given by default are
generated from a seed by ``findings``: keys of public formats as positives; hashes, ids, paths, addresses, placeholders
and long words as negatives. The transition table and the dictionary are counted over all texts, whole; what reaches the
driver is the table and the ``DICTIONARY`` most frequent words (ties: first in code-point order).

Defined cases: null and empty texts have no candidate; candidates of any length are scored whole, in time linear in the
text; an unnamed candidate has 16 characters or more of ``A-Za-z0-9_+/=.-`` with a digit among them or a known prefix;
overlapping patterns give one candidate, the longest from the left; of findings that tie at a cut of a tree the left side
takes them; repeated rows get equal results, one each; scores at ``THRESHOLD`` or more are secrets.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_rows

THRESHOLD = 0.5
TREES = 40
DEPTH = 9
DICTIONARY = 4000
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
#: What a name that sounds like a secret ends in (api_key, access-key, private key: all end in key).
NAMES = ("pass", "password", "passwd", "pwd", "secret", "token", "auth", "credential", "key")
#: Fixed prefixes of public key formats.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "sk-", "AIza", "SG.", "glpat-", "npm_", "eyJ")
#: A name is taken whole, once (possessively), and its end looked back at: each character is read a bounded number of times.
CANDIDATE = re.compile(
    rf"(?i:(?<![\w-])[\w-]++(?:{'|'.join(f'(?<={n})' for n in NAMES)})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)([^\s\"',;]{{6,}})"
    rf"|(?<![A-Za-z0-9_+/=.-])((?=[A-Za-z_+/=.-]*+[0-9]|{'|'.join(map(re.escape, PREFIXES))})[A-Za-z0-9_+/=.-]{{16,}})"
)
NEAR = 24  # characters on each side that count as neighbours
#: Words beside a value that speak for and against a secret.
FOR = ("password", "passwd", "secret", "token", "key", "auth", "credential", "bearer", "login", "aws")
AGAINST = ("commit", "sha", "md5", "checksum", "uuid", "version", "isbn", "order", "example", "hash", "revision", "digest", "file", "path", "build", "test", "sample", "http", "www")
PLACEHOLDER = re.compile(r"(?i)change|example|your|xxx|placeholder|dummy|\*\*\*|<|\$\{|todo|sample|null|none|true|false")
CHARS = "abcdefghijklmnopqrstuvwxyz0123456789_"
WORD = re.compile(r"[^\W\d_]{3,}")


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in characters."""
    out = []
    for m in CANDIDATE.finditer(text or ""):
        g = 1 if m.group(1) is not None else 2
        end = m.end(g)
        while end > m.start(g) + 6 and text[end - 1] in ".,;:!?)":
            end -= 1
        out.append((m.start(g), end))
    return out


_columns: list[np.ndarray] = []


def count(text: str, seen: Counter) -> np.ndarray:
    """The text's transitions by pair; its words are added to ``seen``."""
    if not _columns:
        _columns.append(np.full(0x110000, len(CHARS), np.int64))
        _columns[0][[ord(c) for c in CHARS]] = np.arange(len(CHARS))
    text = text.lower()
    seen.update(WORD.findall(text))
    codes = _columns[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return np.bincount(codes[:-1] * (len(CHARS) + 1) + codes[1:], minlength=(len(CHARS) + 1) ** 2)


class Prose:
    """Transitions and frequent words of ordinary text."""

    def __init__(self, texts: list[str], words: int = DICTIONARY):
        pairs, seen = np.zeros((len(CHARS) + 1) ** 2, np.int64), Counter()
        for text in texts:
            pairs += count(text, seen)
        self._set(pairs, sorted(seen, key=lambda w: (-seen[w], w))[:words])

    @classmethod
    def counted(cls, pairs: np.ndarray, words: list[str]) -> Prose:
        """From the counts of all transitions and the frequent words."""
        out = cls.__new__(cls)
        out._set(pairs, words)
        return out

    def _set(self, pairs: np.ndarray, words: list[str]) -> None:
        counts = 1.0 + pairs.reshape(len(CHARS) + 1, len(CHARS) + 1)
        self.place = {c: i for i, c in enumerate(CHARS)}
        self.cost = -np.log2(counts / counts.sum(1, keepdims=True))
        self.words = {*words} | {"password", "token", "secret", "example", "test", "user", "file", "data", "home", "change", "your", "index", "value"}

    def surprise(self, value: str) -> float:
        codes = [self.place.get(c, len(CHARS)) for c in value.lower()]
        return float(self.cost[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def covered(self, value: str) -> float:
        """The share of characters inside dictionary words, longest first from the left."""
        low, at, inside = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(14, len(low) - at), 2, -1):
                if low[at : at + n] in self.words:
                    inside += n
                    at += n
                    break
            else:
                at += 1
        return inside / max(len(low), 1)


def features(prose: Prose, before: str, value: str, after: str) -> list[float]:
    v = value
    n = len(v)
    counts = Counter(v)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    around = f"{before} {after}".lower()
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 0 for c in v]
    return [
        n,
        sum(k == 1 for k in kinds) / n,
        sum(k == 2 for k in kinds) / n,
        sum(k == 0 for k in kinds) / n,
        entropy,
        entropy / max(math.log2(n), 1),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        prose.surprise(v),
        prose.covered(v),
        float(all(c in string.hexdigits + "-" for c in v)),
        float(v.startswith(PREFIXES)),
        float(v.count("/") + v.count("\\")) + 2.0 * bool(re.match(r"(?:\w+:)?//|www\.|/|~/|\./", v)),
        float(bool(re.search(r"\.[A-Za-z]{2,5}$", v))) + float("@" in v),
        float(v.count("-")),
        float(v.count(".")),
        float(bool(PLACEHOLDER.search(v))),
        float(sum(w in around for w in FOR)),
        float(sum(w in around for w in AGAINST)),
        float(bool(re.search(r"[:=]\s{0,3}[\"']?$", before))),
    ]


def findings(prose_words: list[str], n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings: (before, value, after, 1 for a secret)."""
    rng = random.Random(seed)
    alnum, upper, hexa = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(prose_words)
    name = lambda: rng.choice(("password", "passwd", "token", "secret", "api_key", "access_key", "auth_token", "db_password", "client_secret"))
    given = lambda: name() + rng.choice(("=", ": ", " = ", '="', ' = "'))
    prose = lambda k: " ".join(word() for _ in range(k))
    good = [
        lambda: (prose(3) + " ", "AKIA" + some(upper, 16)),
        lambda: (prose(2) + " " + given(), some(hexa, rng.choice((16, 18, 20, 24, 32, 40)))),
        lambda: (prose(2) + " " + given(), some(alnum, rng.randint(12, 48))),
        lambda: (prose(2) + " " + given(), some(alnum + "!@#$%^&*", rng.randint(8, 20))),
        lambda: (prose(3) + " ", rng.choice(PREFIXES[2:]) + some(alnum, rng.randint(20, 40))),
        lambda: ("Authorization: Bearer ", some(alnum + "-_", rng.randint(24, 60))),
        lambda: (given(), word().capitalize() + some(string.digits, 3) + some(alnum + "!#$", rng.randint(4, 9))),
    ]
    bad = [
        lambda: ("commit " + prose(1) + " ", some(hexa, 40)),
        lambda: (rng.choice(("sha256 ", "md5 checksum ", "build ", "revision ", "digest: ")), some(hexa, rng.choice((32, 40, 64)))),
        lambda: (prose(2) + " uuid ", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (prose(2) + " ", "/" + "/".join(word() for _ in range(rng.randint(2, 5))) + "/" + word() + str(rng.randint(1, 99)) + rng.choice((".txt", ".py", ".log", ""))),
        lambda: (prose(2) + " https:", "//www." + word() + ".com/" + word() + "/" + str(rng.randint(1, 9999))),
        lambda: (prose(3) + " ", some(string.digits, rng.randint(16, 24))),
        lambda: (prose(2) + " ", "-".join(some(string.digits, rng.randint(3, 5)) for _ in range(4))),
        lambda: (prose(3) + " ", word() + word() + word() + str(rng.randint(0, 2030)) + word()),
        lambda: (prose(3) + " ", "_".join((word(), word(), word())) + "_" + str(rng.randint(0, 99))),
        lambda: (given(), rng.choice(("changeme", "your_password_here", "xxxxxxxxxxxx", "example_value", "<password>", "${SECRET}", "placeholder", "none_required", "********"))),
        lambda: (given(), "_".join(word() for _ in range(2))),
        lambda: (prose(2) + " ", word() + "." + str(rng.randint(1, 99)) + "@" + word() + str(rng.randint(1, 9)) + ".example.com"),
        lambda: (rng.choice(("version ", "order ", "isbn ")), some(string.digits, 3) + "." + some(string.digits, 5) + "-" + some(string.digits, 10)),
        lambda: (prose(2) + " token ", "".join(word() for _ in range(3)) + str(rng.randint(0, 9)) + "." + word()),
        lambda: (prose(2) + " ", str(rng.randint(1990, 2030)) + "-" + "".join(word() for _ in range(2)) + "-" + word()),
    ]
    out = []
    for i in range(n):
        before, value = rng.choice(good if i % 2 else bad)()
        out.append((before[-NEAR:], value, rng.choice((" ", '" ', ". ", "\n")) + prose(1), i % 2))
    return out


class Forest:
    """Bagged Gini trees over columns of numbers, as flat arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([cls._tree(x[b], y[b], depth, rng) for b in (rng.integers(len(x), size=len(x)) for _ in range(trees))])

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
        best, total = (0.0, -1, 0.0), y.sum()
        whole = total * (len(y) - total) / len(y)
        left = np.arange(1, len(y))
        for c in columns:
            order = np.argsort(x[:, c], kind="stable")
            v, ones = x[order, c], np.cumsum(y[order])[:-1]
            cut = v[1:] > v[:-1]
            if not cut.any():
                continue
            right = len(y) - left
            impurity = ones * (left - ones) / left + (total - ones) * (right - total + ones) / right
            impurity[~cut] = np.inf
            i = int(impurity.argmin())
            if whole - impurity[i] > best[0] + 1e-12:
                best = (whole - impurity[i], int(c), float((v[i] + v[i + 1]) / 2))
        return best

    @classmethod
    def _tree(cls, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, cut, child, share = [], [], [], []
        queue = [(np.arange(len(y)), depth)]
        while queue:
            rows, left = queue.pop(0)
            node = len(column)
            share.append(float(y[rows].mean()))
            gain, c, t = (0.0, -1, 0.0)
            if left and len(rows) >= 4 and 0 < share[-1] < 1:
                gain, c, t = cls._split(x[rows], y[rows], rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False))
            column.append(c)
            cut.append(t)
            child.append(0)
            if c >= 0:
                child[node] = node + 1 + len(queue)
                low = x[rows, c] <= t
                queue += [(rows[low], left - 1), (rows[~low], left - 1)]
        return np.array(column), np.array(cut), np.array(child), np.array(share)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves."""
        out = np.zeros(len(x))
        for column, cut, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(column[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = child[node] + (x[inner, column[node]] > cut[node])
            out += share[at]
        return out / len(self.trees)


def prose_of(docs: DataFrame, words: int = DICTIONARY) -> Prose:
    """Prose statistics of all texts: counted in the tasks, summed by key, and only the frequent words collected."""

    def run(batches):
        import pyarrow as pa

        pairs, seen = np.zeros((len(CHARS) + 1) ** 2, np.int64), Counter()
        handed = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "n"])
        for batch in batches:
            for text in batch.column(0):
                pairs += count(text.as_py(), seen)
                if len(seen) >= HELD_WORDS:
                    yield handed(list(seen), list(seen.values()))
                    seen.clear()
        yield handed(list(seen), list(seen.values()))
        met = np.flatnonzero(pairs)
        yield handed([f" {i}" for i in met], pairs[met])  # no word starts with a space

    total = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = (len(CHARS) + 1) ** 2
    rows = total.orderBy(F.col("key").startswith(" ").desc(), F.col("n").desc(), "key").limit(table + words).collect()
    pairs = np.zeros(table, np.int64)
    for r in rows:
        if r["key"][0] == " ":
            pairs[int(r["key"])] = r["n"]
    return Prose.counted(pairs, [r["key"] for r in rows if r["key"][0] != " "][:words])


def train(docs: DataFrame, labelled: list[tuple[str, str, str, int]] | None = None) -> tuple[Prose, Forest]:
    """Prose statistics of the whole corpus and a forest from labelled findings."""
    prose = prose_of(docs)
    words = sorted(w for w in prose.words if w.isascii())
    rows = findings(words) if labelled is None else labelled
    x = np.array([features(prose, b, v, a) for b, v, a, _ in rows])
    return prose, Forest.fit(x, np.array([r[3] for r in rows]))


def scan(texts: list[str | None], prose: Prose, forest: Forest) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates (start, end, score)."""
    places, rows = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text):
            places.append((i, a, b))
            rows.append(features(prose, text[max(0, a - NEAR) : a], text[a:b], text[b : b + NEAR]))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if rows:
        for (i, a, b), s in zip(places, forest.predict(np.array(rows)), strict=True):
            out[i].append((a, b, float(s)))
    return out


def redacted(text: str, found: list[tuple[int, int, float]], threshold: float = THRESHOLD) -> str:
    out, at = [], 0
    for a, b, s in found:
        if s >= threshold:
            out += [text[at:a], "[SECRET]"]
            at = b
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, model: tuple[Prose, Forest] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, starts, ends, scores, redacted: one pass, no shuffle; the model has a fixed size."""
    prose, forest = model or train(docs)
    shipped = docs.sparkSession.sparkContext.broadcast((prose, forest))

    def make():
        prose, forest = shipped.value

        def run(c):
            found = scan(c["text"], prose, forest)
            return {
                "doc_id": c["doc_id"],
                "n_candidates": [len(f) for f in found],
                "n_secrets": [sum(s >= threshold for *_, s in f) for f in found],
                "starts": [[a for a, _, _ in f] for f in found],
                "ends": [[b for _, b, _ in f] for f in found],
                "scores": [[s for *_, s in f] for f in found],
                "redacted": [None if t is None else redacted(t, f, threshold) for t, f in zip(c["text"], found, strict=True)],
            }

        return run

    schema = "doc_id long, n_candidates long, n_secrets long, starts array<long>, ends array<long>, scores array<double>, redacted string"
    return map_rows(docs.select("doc_id", "text"), schema, make, 4 << 20)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start-end of each secret), redacted_sha256."""
    out = scanned(docs)
    hits = F.filter(F.arrays_zip("starts", "ends", "scores"), lambda s: s["scores"] >= THRESHOLD)
    spans = F.array_join(F.transform(hits, lambda s: F.concat_ws("-", s["starts"], s["ends"])), ",")
    return out.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"), F.sha2(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8"), 256).alias("redacted_sha256"))

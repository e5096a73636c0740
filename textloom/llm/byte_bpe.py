"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each adjacent pair
encodes to that pair. So the encoding of every prefix of a word ends in one token, found from the encodings of shorter
prefixes, and a left-to-right machine needs only the open starts: positions from which the bytes read so far still lead
into some token, each with the tokens that end there. A state of the transducer is that list, with the tokens common to
all open starts already emitted; lookahead is therefore bounded by the longest token. States and transitions are made
when first met and kept in a bounded table, as are the outputs of frequent words.

Decoding maps ids to bytes in chunks; a UTF-8 state machine holds back the (at most three) bytes of an unfinished character.

Defined cases: null and empty texts give no ids; repeated words, long runs and texts of any length take linear time; ids
outside the vocabulary are an error; bytes that are no UTF-8 decode to U+FFFD as Python's ``replace`` does.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame

from textloom.llm.common import map_rows, one_model

#: Bounds of the tables in each Python worker.
MAX_STATES = 120_000
MAX_WORDS = 200_000
MAX_LENGTH = 64
MAX_PAIRS = 400_000
CHUNK = 4096

#: Letters and numbers of Unicode versions after 16, which the tokenizer's own tables do not have yet.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _inside(points: str) -> str:
    """A class body of code points and ranges."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in points.split())


class _Split:
    """Texts into words by the pattern, in the tokenizer's Unicode version."""

    def __init__(self, pattern: str):
        import regex

        # the engine's \s also takes U+001C to U+001F, which are no white space to the tokenizer
        pattern = pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        letters, numbers = _inside(LATER_LETTERS), _inside(LATER_NUMBERS)
        exact = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]||[{letters}{numbers}]]")
        exact = exact.replace(r"?\p{L}+", f"?[\\p{{L}}--[{letters}]]+").replace(r"?\p{N}+", f"?[\\p{{N}}--[{numbers}]]+")
        self.usual = regex.compile(pattern).findall
        self.exact = regex.compile(exact, regex.V1).findall
        self.later = regex.compile(f"[{letters}{numbers}]").search

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later(text):
                return self.exact(text)
        return self.usual(text)


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State(dict):
    """byte -> (next state, emitted ids); ``flush``: what a word ending here still emits."""

    __slots__ = ("open", "flush", "machine")

    def __init__(self, machine: Transducer, open_: tuple):
        self.machine, self.open, self.flush = machine, open_, open_[-1][2]

    def __missing__(self, byte: int):
        return self.machine.extend(self, byte)


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token: list[int] = [-1]  # id of the token that a node spells
        for spelled, i in ranks.items():
            node = 0
            for b in spelled:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i
        self.inner = {key >> 8 for key in self.child}  # nodes that lead further
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states met so far."""
        for state in getattr(self, "states", {}).values():
            state.clear()  # they point at each other
        self.states: dict[tuple, _State] = {}
        self.start = self.state(((0, -1, ()),))

    def state(self, open_: tuple) -> _State:
        found = self.states.get(open_)
        if found is None:
            found = self.states[open_] = _State(self, open_)
        return found

    def merge(self, word: bytes) -> list[int]:
        """BPE by definition: merge the adjacent pair of least rank, leftmost first. Only used on single tokens and pairs."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: the word's start)."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            if left < 0:
                found = self.merge(self.bytes_of[right]) == [right]
            else:
                found = self.fits(-1, right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = found
        return found

    def extend(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The transition, made on first use. Open starts are (node, last token, tokens not emitted yet), oldest first."""
        going, ends, child, token, inner, known = [], None, self.child, self.token, self.inner, self.pairs
        for node, last, held in state.open:
            node = child.get(node << 8 | byte)
            if node is not None:
                if node in inner:
                    going.append((node, last, held))
                if ends is None and (t := token[node]) >= 0:
                    good = known.get((last, t))
                    if self.fits(last, t) if good is None else good:
                        ends = (0, t, (*held, t))
        if ends is None:
            raise ValueError("the vocabulary lacks a single byte")
        going.append(ends)
        sure = going[0][2]  # what all open starts have in common
        for _, _, held in going:
            if held[: len(sure)] != sure:
                n = 0
                for a, b in zip(held, sure, strict=False):
                    if a != b:
                        break
                    n += 1
                sure = sure[:n]
        if sure:
            n, emitted = len(sure), sure
            going = [(node, last, held[n:]) for node, last, held in going]
        else:
            emitted = ()
        if len(self.states) >= self.max_states:
            self.reset()
        out = (self.state(tuple(going)), emitted)
        state[byte] = out
        return out

    def encode(self, word: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in word:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        return (*out, *state.flush)

    def stream(self, word: Iterable[int]) -> Iterator[int]:
        """Ids of one word as its bytes come in."""
        state = self.start
        for byte in word:
            state, emitted = state[byte]
            yield from emitted
        yield from state.flush


class _Words(dict):
    """Ids of words met lately: two generations of at most ``bound`` words, words met again move to the new one."""

    def __init__(self, machine: Transducer, bound: int):
        self.machine, self.bound, self.old = machine, bound, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.machine.encode(word.encode())
        if len(word) <= MAX_LENGTH:
            self[word] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: the state is the unfinished character, of at most three bytes."""

    #: Least lead byte of characters of 2, 3 and 4 bytes.
    LEADS = ((0xF0, 4), (0xE0, 3), (0xC0, 2))

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[cut - back]
            if b >= 0xC0:
                need = next(n for least, n in self.LEADS if b >= least)
                # an unfinished character is kept only if what is there can still become one
                if need > back and self._open(data[cut - back :]):
                    cut -= back
                break
            if b < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(piece: bytes) -> bool:
        try:
            piece.decode()
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data"
        return False

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder for one rank file; ``pattern`` splits a text into words that are merged apart.

    ``room`` scales the tables' bounds: 1 takes about 400 MB, 2 about 550 MB, less is slower.
    """

    def __init__(self, path: str, pattern: str | None = None, room: float = 1.0):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.split = _Split(pattern)
        self.machine = Transducer(vocabulary(path), int(room * MAX_STATES), int(room * MAX_PAIRS))
        self.words = _Words(self.machine, int(room * MAX_WORDS))
        self.bytes_of = self.machine.bytes_of

    def close(self) -> None:
        """Take the tables apart, as they point at each other."""
        self.machine.reset()
        self.machine.start.clear()
        self.machine.states.clear()
        self.machine.pairs.clear()
        self.machine.child.clear()
        self.words.clear()
        self.words.old.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text or ""))))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        ids, machine = iter(ids), Utf8Stream()
        while chunk := list(islice(ids, CHUNK)):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, chunk)))
        yield machine.end()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokenizer(path: str, room: float = 1.0) -> ByteBpe:
    """One a worker. Its tables are many small objects, so the cycle collector is kept off them while it is there."""

    def load() -> ByteBpe:
        gc.disable()
        return ByteBpe(path, room=room)

    return one_model(("bpe", path, room), load)


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: doc_id) with ``ids array<int>`` of the whole ``text``."""
    path, keep = path or default_path(), keep or ["doc_id"]

    def make():
        bpe = tokenizer(path)
        return lambda c: {k: c[k] for k in keep} | {"ids": [bpe.encode(t) for t in c["text"]]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_rows(docs.select(*keep, "text") if "text" not in keep else docs.select(*keep), f"{kinds}, ids array<int>", make, 4 << 20)


def decode(encoded: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with ``text`` from ``ids``."""
    path, keep = path or default_path(), keep or ["doc_id"]

    def make():
        bpe = tokenizer(path)
        return lambda c: {k: c[k] for k in keep} | {"text": [bpe.decode(x or []) for x in c["ids"]]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return map_rows(encoded.select(*keep, "ids"), f"{kinds}, text string", make, 4 << 20)


def encoded_and_checked(docs: DataFrame, path: str | None = None, room: float = 0.5) -> DataFrame:
    """doc_id, source, ids, n_tokens, round_trip: whether the decoded ids are the text (null texts: the empty one).

    Small tables by default: in a pipeline the workers share an executor with joins.
    """
    path = path or default_path()

    def make():
        bpe = tokenizer(path, room)

        def run(c):
            ids = [bpe.encode(t) for t in c["text"]]
            same = [bpe.decode(x) == (t or "") for x, t in zip(ids, c["text"], strict=True)]
            return {"doc_id": c["doc_id"], "source": c["source"], "ids": ids, "n_tokens": [len(x) for x in ids], "round_trip": same}

        return run

    schema = "doc_id long, source string, ids array<int>, n_tokens long, round_trip boolean"
    return map_rows(docs.select("doc_id", "source", "text"), schema, make, 2 << 20)


def digest(docs: DataFrame, path: str | None = None, room: float = 2.0) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256. Encodes and decodes in one pass over the texts."""
    path = path or default_path()

    def make():
        bpe = tokenizer(path, room)
        decimal = {i: str(i) for i in bpe.bytes_of}

        def run(c):
            n, coded, back = [], [], []
            for text in c["text"]:
                ids = bpe.encode(text)
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                whole = hashlib.sha256()
                for piece in bpe.decode_stream(ids):
                    whole.update(piece.encode())
                back.append(whole.hexdigest())
            return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": coded, "decoded_sha256": back}

        return run

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, 4 << 20)

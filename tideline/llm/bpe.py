"""Byte pair encoding and decoding with an automaton compiled from the merges.

The automaton reads tokens; its arcs are labelled with the bytes of a token. It starts as one
state with an arc for every byte. Each merge ``u v -> w`` then adds one gadget, in rank order:

* the state after ``u`` is split from the others and loses its arc ``v``;
* ``w`` gets an arc from every state that has an arc ``u`` at that moment, ``u``'s own new state
  included, into a copy of the state after ``v``.

So there is one state per token. A path of the automaton spells a text exactly if it is the
result of the merges, and every text has one such path. Copies are not written out: a state
keeps its own lost arcs and a link to the state it was copied from, with the rank at which that
happened, and an arc keeps a link to the arc it was added beside. ``arc`` follows these links
once per pair and keeps the answer in the transition table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from tideline.llm.batches import others, with_results

# The pattern by which byte-level tokenizers of this kind split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encoding a task remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
_NEVER = 1 << 60
# The same pattern for texts of Latin letters only, whose classes can be listed.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
# Characters outside the blocks whose letters and digits have long been settled.
_UNUSUAL = re.compile("[^\x00-\u0557\u2010-\u2064\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class MergeAutomaton:
    """The automaton of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.labels: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.special.items():
            self.labels.extend([b""] * (i + 1 - len(self.labels)))
            self.labels[i] = text.encode()
        n = len(self.labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.lost: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.tokens: dict[bytes, int] = {
            bytes([b]): vocab[c] for c, b in letters.items() if c in vocab}
        for rank, pair in enumerate(spec["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(map(len, self.tokens))
        self.splitter = regex.compile(WORDS)
        self.cut = regex.compile("|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self._library = None

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if not self._open(u, v):
            return  # no path holds u v any more, so nothing would ever enter w
        self.lost[u << 20 | v] = rank
        self.left[w], self.right[w], self.born[w] = u, v, rank
        self.tokens[self.labels[w]] = w

    def _open(self, x: int, y: int) -> bool:
        """Whether the state after ``x`` has an arc ``y``, by the links of states and of arcs."""
        state, copied = x, _NEVER
        while True:
            arc, added = y, _NEVER
            while True:
                at = self.lost.get(state << 20 | arc)
                if at is not None and at < copied and at <= added:
                    return False
                if self.born[arc] < 0:
                    break
                added, arc = self.born[arc], self.left[arc]
            if self.born[state] < 0:
                return True
            copied, state = self.born[state], self.right[state]

    def arc(self, x: int, y: int) -> bool:
        key = x << 20 | y
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            found = self.table[key] = self._open(x, y)
        return found

    def word(self, raw: bytes) -> tuple[int, ...]:
        """The path that spells ``raw``: longest arcs first, one step back from a dead end."""
        get, arc, longest, labels = self.tokens.get, self.arc, self.longest, self.labels
        n, path, at, end = len(raw), [], 0, min(len(raw), self.longest)
        dead: set[int] = set()
        while at < n:
            while end > at:
                token = get(raw[at:end])
                if token is not None and end not in dead and (not path or arc(path[-1], token)):
                    path.append(token)
                    at, end = end, min(n, end + longest)
                    break
                end -= 1
            else:
                dead.add(at)
                end = at - 1
                at -= len(labels[path.pop()])
        return tuple(path)

    def _words(self, text: str) -> Sequence[str]:
        if text.isascii() or not _BEYOND_LATIN.search(text):
            return _LATIN_WORDS.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in _UNUSUAL.findall(text)):
            # younger than this interpreter's Unicode tables: the library decides what a letter is
            if self._library is None:
                from tokenizers.pre_tokenizers import Split
                from tokenizers import Regex
                self._library = Split(Regex(WORDS), "isolated")
            return [w for w, _ in self._library.pre_tokenize_str(text)]
        return self.splitter.findall(text)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        known, out = self.known, []
        for w in self._words(text):
            path = known.get(w)
            if path is None:
                path = self.word(w.encode())
                if len(w) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = path
            out.append(path)
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(self._plain(text)))
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids.extend(chain.from_iterable(self._plain(text[at:m.start()])))
            ids.append(self.special[m[0]])
            at = m.end()
        ids.extend(chain.from_iterable(self._plain(text[at:])))
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, one after the other; bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_COMPILED: dict[str, MergeAutomaton] = {}


def automaton(path: str) -> MergeAutomaton:
    """The automaton of a file, compiled once per Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = MergeAutomaton(path)
    return _COMPILED[path]


def _ids(rows: Sequence[Sequence[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _round_trip(path: str, decode: bool) -> Callable[[], Callable[..., list[pa.Array]]]:
    def make():
        machine = automaton(path)

        def work(text: pa.Array) -> list[pa.Array]:
            rows = [machine.encode(t or "") for t in text.to_pylist()]
            out = [_ids(rows)]
            if decode:
                out.append(pa.array([machine.decode(r) for r in rows], pa.string()))
            return out
        return work
    return make


IDS = StructField("ids", ArrayType(IntegerType()))
DECODED = StructField("decoded", StringType())


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` and the token ids of every whole text as array ``ids``.

    ``path`` is a byte-level tokenizer file that every executor has. Null and empty texts have no
    tokens. Special strings of the file become their own ids. Rows are handled one by one:
    repeated rows stay, an empty table gives an empty result, and an older column ``ids`` is
    replaced.
    """
    return with_results(docs, [text], others(docs, ["ids"]), [IDS], _round_trip(path, False))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Like ``encode_texts``, with what the ids decode to as string ``decoded`` (null text: empty)."""
    return with_results(docs, [text], others(docs, ["ids", "decoded"]), [IDS, DECODED],
                        _round_trip(path, True))


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` and its token ids decoded as string ``decoded``; a null list is an empty text."""
    from pyspark.sql import functions as F

    from tideline.llm.batches import quoted

    def make():
        machine = automaton(path)

        def work(joined: pa.Array) -> list[pa.Array]:
            return [pa.array([machine.decode([int(i) for i in x.split(",")] if x else [])
                              for x in joined.to_pylist()], pa.string())]
        return work

    keep = others(df, ["decoded"])
    source = df.select(
        *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(keep)],
        F.array_join(F.col(quoted(ids)).cast("array<string>"), ",").alias("joined"))
    out = with_results(source, ["joined"], [f"c{k}" for k in range(len(keep))], [DECODED], make)
    return out.toDF(*keep, "decoded")

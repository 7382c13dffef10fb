"""Benchmark passages in documents, found with Wu-Manber multi-pattern search.

A window is a run of consecutive words of a benchmark item. Windows are written as bytes with one
space before every word and one after the last, documents likewise, so that a byte match is a
match of whole words. The search looks at the last block of bytes of a possible position: a shift
table says how far the next position that can match is; where the shift is zero, a bucket of the
block's hash names the windows to try, and these are compared directly. Windows of very different
length are searched apart, because the shortest one bounds every shift.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tideline.llm.batches import others, quoted, spans, staged, with_results
from tideline.session import Scratch

#: Words of a window.
WORDS = 10
#: Bytes of benchmark texts and ids that a pass over the documents searches for, and the buckets of
#: texts, on average, that a pass is put together from.
PASS_BYTES = 2 << 20
_BUCKETS = 16
_LANE = 1024  # positions that are searched one after the other; lanes advance together
_K = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> np.ndarray:
    """Byte to lower-case word byte, or to a space."""
    table = np.full(256, 32, np.uint8)
    for b in (*range(48, 58), *range(97, 123), *range(128, 256)):
        table[b] = b
    table[65:91] = np.arange(97, 123)
    return table


FOLD = _fold()


def words_of(text: str | None) -> list[bytes]:
    return FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split(b" ") if text else []


def windows_of(text: str | None, n: int) -> set[bytes]:
    """The windows of an item as bytes."""
    words = [w for w in words_of(text) if w]
    return {b" " + b" ".join(words[k:k + n]) + b" " for k in range(max(1, len(words) - n + 1))} if words else set()


def spell(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in the form that is searched; where each word begins in it; words of each text."""
    folded = raw.tobytes().translate(FOLD.tobytes())
    ends = offsets.tolist()
    joined = np.frombuffer(
        b" " + b"  ".join([folded[a:b] for a, b in zip(ends, ends[1:])]) + b"  ", np.uint8)
    word = joined != 32
    keep = word.copy()
    keep[:-1] |= word[1:]
    keep[offsets[1:] + 2 * np.arange(len(ends) - 1) + 1] = True  # the space after a text
    text = np.concatenate([joined[keep], np.full(8, 32, np.uint8)])
    space = text == 32
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    # a text ends where a space follows that begins no word
    breaks = np.flatnonzero(space[:-1] & space[1:])[:len(ends) - 1]
    return text, begins, np.diff(np.searchsorted(begins, breaks), prepend=0)


class WuManber:
    """Search for patterns whose lengths lie between ``shortest`` and twice that, or any above."""

    def __init__(self, patterns: Sequence[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.patterns = list(patterns)
        self.length = np.array([len(p) for p in patterns])
        heads = np.frombuffer(b"".join(p[:self.m] + b"\0" * 8 for p in patterns), np.uint8).reshape(len(patterns), -1)
        ends = self.m - self.block + 1
        blocks = np.stack([self._load(np.ascontiguousarray(heads[:, k:k + 8])) for k in range(ends)], 1)
        bits = min(24, max(10, int(np.ceil(np.log2(16 * len(np.unique(blocks)))))))
        self.down = np.uint64(64 - bits)
        hashes = self._hash(blocks)
        most = min(ends, 255)
        self.shift = np.full(1 << bits, most, np.uint8)
        for k in range(ends):
            far = ends - 1 - k
            if far < most:
                np.minimum.at(self.shift, hashes[:, k], np.uint8(far))
        last = hashes[:, -1]
        self.by_bucket = np.argsort(last, kind="stable")
        self.buckets, self.bucket_at = np.unique(last[self.by_bucket], return_index=True)
        self.bucket_end = np.append(self.bucket_at[1:], len(last))
        self.suffix = blocks[:, -1]
        self.prefix = blocks[:, 0]

    def _load(self, rows: np.ndarray) -> np.ndarray:
        return rows.view("<u8").ravel() & self.mask

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _K) >> self.down).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the patterns that occur in ``text`` (which ends in 8 spare bytes)."""
        n = len(text) - 8
        view = np.ndarray(n + 1, "<u8", text, strides=(1,))
        # a position is the start of the last block of the first m bytes of a possible match
        at = np.arange(self.m - self.block, max(0, n - self.block + 1), _LANE)
        end = np.minimum(at + _LANE, n - self.block + 1)
        stops = []
        while len(at):
            shift = self.shift[self._hash(view[at] & self.mask)]
            stop = shift == 0
            if stop.any():
                stops.append(at[stop])
            at = at + np.maximum(shift, 1)
            go = at < end
            at, end = at[go], end[go]
        if not stops:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(stops)
        found = self._hash(view[at] & self.mask)
        k = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        hit = self.buckets[k] == found
        at, k = at[hit], k[hit]
        many = self.bucket_end[k] - self.bucket_at[k]
        which = self.by_bucket[np.repeat(self.bucket_at[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        start = at - (self.m - self.block)
        ok = ((view[at] & self.mask) == self.suffix[which]) & ((view[start] & self.mask) == self.prefix[which])
        ok &= start + self.length[which] <= n
        start, which = start[ok], which[ok]
        held = text.tobytes()
        same = [held.startswith(self.patterns[w], s) for s, w in zip(start.tolist(), which.tolist())]
        ok = np.array(same, bool)
        return start[ok], which[ok]


class Windows:
    """All windows of some benchmark items, searched for by classes of length."""

    def __init__(self, items: Iterable[tuple[Sequence[str], str | None]], n: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for ids, text in items:
            for w in windows_of(text, n):
                owners[w].update(ids)
        self.patterns = sorted(owners)
        self.owners = [sorted(owners[p]) for p in self.patterns]
        self.words = np.array([p.count(b" ") - 1 for p in self.patterns])
        classes: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(self.patterns):
            classes[min(len(p).bit_length(), 6)].append(k)
        self.searches = [(np.array(ks), WuManber([self.patterns[k] for k in ks])) for ks in classes.values()]

    def hits(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then for every occurrence its first word (counted over all texts),
        number of words and window."""
        text, begins, counts = spell(offsets, raw)
        word, which = [], []
        for ks, search in self.searches:
            at, k = search.find(text)
            word.append(np.searchsorted(begins, at))
            which.append(ks[k])
        which_all = np.concatenate(which) if which else np.empty(0, np.int64)
        word_all = np.concatenate(word) if word else np.empty(0, np.int64)
        return counts, word_all, self.words[which_all] if len(which_all) else which_all, which_all


SPAN = StructType([StructField("first", LongType()), StructField("last", LongType())])
RESULT = [
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(SPAN)),
    StructField("items", ArrayType(StringType())),
]


def _merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(items: list[tuple[list[str], str]], n: int, later: bool):
    def make():
        windows = Windows(items, n)

        def work(text: pa.Array, *before: pa.Array) -> list[pa.Array]:
            counts, word, size, which = windows.hits(*spans(text))
            base = np.concatenate([[0], np.cumsum(counts)])
            doc = np.searchsorted(base, word, "right") - 1
            pairs: list[list[tuple[int, int]]] = [[] for _ in counts]
            names: list[set[str]] = [set() for _ in counts]
            if later:
                for k, (old, ids) in enumerate(zip(before[0].to_pylist(), before[1].to_pylist())):
                    pairs[k] = [(x["first"], x["last"]) for x in old]
                    names[k] = set(ids)
            first = word - base[doc]
            for d, a, b, w in zip(doc.tolist(), first.tolist(), (first + size - 1).tolist(), which.tolist()):
                pairs[d].append((a, b))
                names[d].update(windows.owners[w])
            hits = [[{"first": a, "last": b} for a, b in _merge(p)] for p in pairs]
            return [
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
        return work
    return make


def _passes(bench: DataFrame, pass_bytes: int, scratch: Scratch) -> list[DataFrame]:
    """``bench`` (``item``, ``text``) as texts with their ``ids``, in parts of at most ``pass_bytes``."""
    sizes = bench.agg(F.sum(F.octet_length("text")).alias("text"), F.sum(F.octet_length("item")).alias("ids")).first()
    # ids of one text are dealt out when all ids together are more than a pass
    deals = max(1, -(-2 * (sizes["ids"] or 0) // pass_bytes))
    least = max(1, -(-((sizes["text"] or 0) + (sizes["ids"] or 0)) // pass_bytes))
    texts = bench.distinct().withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(deals))).groupBy("text", "deal").agg(
        F.collect_set("item").alias("ids"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes"))
    if least == 1:
        return [texts]
    held = staged(texts.select(
        "text", "ids", (F.col("bytes") + F.octet_length("text")).alias("bytes"),
        F.pmod(F.xxhash64("text", "deal"), F.lit(_BUCKETS * least)).alias("bucket")), "benchmark-texts", scratch)
    parts, first, total = [], 0, 0
    for r in held.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).orderBy("bucket").collect():
        if total and total + r["bytes"] > pass_bytes:
            parts.append((first, r["bucket"]))
            first, total = r["bucket"], 0
        total += r["bytes"]
    parts.append((first, _BUCKETS * least))
    return [held.where((F.col("bucket") >= a) & (F.col("bucket") < b)).select("text", "ids") for a, b in parts]


def mark_benchmark(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, text: str = "text",
    item: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``docs`` with the benchmark windows found in every whole text.

    Adds ``n_words``; ``hits``, the runs of words (numbers of the first and last, from 0) that lie
    inside an occurrence of a window; and ``items``, the ids (as strings, in order) of the items
    with a window that occurs. Older columns of these names are replaced.

    A text that is null, empty or without words has no hits, an item without words no windows, an
    item of fewer than ``words`` words is one window. Repeated rows are marked one by one, a
    repeated item id is listed once, a null item id not at all, though its windows count. The
    windows of a pass go to every task: equal texts are one text with several ids, and a benchmark of
    more than ``pass_bytes`` takes several passes over the documents, written in between. A pass
    holds at most that many bytes, or one bucket of texts (a sixteenth of it on average) if that is more.
    """
    bench = benchmark.select(
        F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(item_text)).alias("text")).where("text is not null")
    keep = others(docs, [f.name for f in RESULT])
    out = docs
    with Scratch(docs.sparkSession) as scratch:
        parts = _passes(bench, pass_bytes, scratch)
        for k, part in enumerate(parts):
            items = [(r["ids"], r["text"]) for r in part.collect()]
            more = ["hits", "items"] if k else []
            out = with_results(out, [text, *more], keep, RESULT, _search(items, words, bool(k)))
            if k + 1 < len(parts):
                out = staged(out, "benchmark-pass")
    return out

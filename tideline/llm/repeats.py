"""Exact removal of repeated byte strings by bucket-pointer refinement.

A position stands for the string of a fixed length that starts there. Positions begin in buckets
of equal 8-grams, and buckets are refined by the bucket identifiers of positions further on: the
identifier for twice the length joins those of a position and of the one a length later, and the
new identifiers serve the next refinement at once. Identifiers depend on the string alone, so
buckets of different tasks agree. A position that is alone in its bucket can have no repeat and
leaves; only the others are sorted further.

Not every position is shuffled at half the length. Of all positions within reach of a string, the
one with the least 16-gram identifier is its anchor; equal strings have equal anchors at the same
distance. So buckets of anchors at half the length decide first, and only strings whose anchor
shares its bucket are refined to the whole length and sorted.

Strings are measured in bytes, or in words between ASCII white space. Then a position is a word,
and the first buckets are those of equal words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)
from pyspark.sql.window import Window

from tideline.llm.batches import cleaning, others, prepare, quoted, slices, spans, staged
from tideline.session import Scratch

#: Bytes of a string that counts as repeated, and words of one that is measured in words.
LENGTH, WORDS = 400, 50
#: Anchors of one bucket that are sorted together; larger buckets are split.
TOGETHER = 1000
#: Positions that a task sorts at once.
SORTED = 1 << 20
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(32)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def refine(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Identifiers of joined strings from those of their parts."""
    out = near * _A
    out += far
    out ^= out >> _R
    out *= _B
    out ^= out >> _R
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Bytes:
    """The positions of texts: all bytes, with the identifiers of their 8-grams."""

    gram, least = 8, 16

    def __init__(self, column: pa.Array):
        self.offsets, self.raw = spans(column)

    def first(self, length: int) -> np.ndarray:
        data = np.concatenate([self.raw, np.zeros(2 * length + 16, np.uint8)])
        return np.ndarray(len(self.raw) + 2 * length, "<u8", data, strides=(1,)).copy()

    def places(self, k: int, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of text ``k`` from a position to before another one."""
        return first, after


class Words:
    """The positions of texts: their words, with the hashes of these."""

    gram, least = 1, 4

    def __init__(self, column: pa.Array):
        self.at, self.raw = spans(column)
        inside = np.append(~_SPACE[self.raw], False)
        before = np.concatenate([[False], inside[:-1]])
        before[self.at] = False
        self.begin = np.flatnonzero(inside & ~before)
        cut = inside.copy()
        cut[self.at[self.at > 0] - 1] = False  # a text ends its last word
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | ~cut[:-1])) + 1
        self.end = ends
        self.offsets = np.searchsorted(self.begin, self.at)

    def first(self, length: int) -> np.ndarray:
        data, digest = self.raw.tobytes(), xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(data[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist())),
                             np.uint64, len(self.begin))
        return np.concatenate([hashes, np.zeros(2 * length, np.uint64)])

    def places(self, k: int, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = self.offsets[k]
        return self.begin[words + first] - self.at[k], self.end[words + after - 1] - self.at[k]


UNITS = {"bytes": Bytes, "words": Words}


def identifiers(text: Bytes | Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of all positions for twice the first gram and for ``length``.

    Positions less than that before the end of a text get numbers without a meaning.
    """
    ids, at, seed, n = text.first(length), text.gram, None, text.offsets[-1]
    while at < length:
        step = min(at, length - at)
        ids = refine(ids[:-step], ids[step:])
        at += step
        seed = ids if seed is None else seed
    return (ids if seed is None else seed)[:n], ids


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def anchors(text: Bytes | Words, length: int) -> tuple[np.ndarray, ...]:
    """Runs of positions with the same anchor: text, first position in it, how many, and the
    anchor's identifier at half the length."""
    half, offsets = length // 2, text.offsets
    sizes = np.diff(offsets)
    strings = np.maximum(0, sizes - length + 1)
    if not strings.any():
        return tuple(np.empty(0, np.int64) for _ in range(4))
    seed, ids = identifiers(text, half)
    least = (seed & _HIGH) | np.arange(len(seed), dtype=np.uint64)
    width, wide = 1, half + 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = ranges(offsets[:-1], strings)
    anchor = (least[at] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first = at[new]
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], np.diff(np.append(new, len(at))), ids[anchor[new]].view(np.int64)


ANCHORS = StructType([
    StructField("h1", LongType()), StructField("h2", LongType()), StructField("first", IntegerType()),
    StructField("n", IntegerType()), StructField("key", LongType())])
RUNS = StructType([
    StructField("key", LongType()), StructField("salt", IntegerType()), StructField("salts", IntegerType()),
    StructField("h1", LongType()), StructField("h2", LongType()), StructField("first", IntegerType()),
    StructField("ids", BinaryType())])
FOUND = StructType([
    StructField("h1", LongType()), StructField("h2", LongType()),
    StructField("first", IntegerType()), StructField("last", IntegerType()),
    StructField("key", LongType()), StructField("id", LongType())])
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
CHANGED = StructType([
    StructField("h1", LongType()), StructField("h2", LongType()),
    StructField("spans", SPANS), StructField("kept", BinaryType())])


def _batch(schema: StructType, *columns) -> pa.RecordBatch:
    kinds = {LongType(): pa.int64(), IntegerType(): pa.int32()}
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kinds[f.dataType]) for f, c in zip(schema.fields, columns)],
        names=schema.names)


def _at(batch: pa.RecordBatch, name: str) -> int:
    return batch.schema.get_field_index(name)  # a plan may reorder columns


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(_at(batch, name)).to_numpy(zero_copy_only=False)


def _find_anchors(length: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _at(batch, "text")):
                doc, first, n, key = anchors(UNITS[unit](part.column(_at(part, "text"))), length)
                if len(doc):
                    yield _batch(ANCHORS, _numbers(part, "h1")[doc], _numbers(part, "h2")[doc], first, n, key)
    return run


def _refine_runs(length: int, unit: str):
    """Identifiers at the whole length for the runs whose anchors share a bucket."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _at(batch, "text")):
                text = UNITS[unit](part.column(_at(part, "text")))
                runs = part.column(_at(part, "runs"))
                each = np.diff(runs.offsets.to_numpy())
                first, n, key, salts = (f.to_numpy(zero_copy_only=False) for f in runs.flatten().flatten())
                doc = np.repeat(np.arange(part.num_rows), each)
                _, ids = identifiers(text, half)
                at = ranges(text.offsets[doc] + first, n)
                full = refine(ids[at], ids[at + half])
                ends = np.concatenate([[0], np.cumsum(8 * n.astype(np.int64))]).astype(np.int32)
                blob = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(full))])
                h1, h2 = _numbers(part, "h1")[doc], _numbers(part, "h2")[doc]
                yield _batch(RUNS, key, (h1 ^ first) % salts, salts, h1, h2, first, blob)
    return run


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated positions within a bucket of anchors; of split buckets also one position of every
    string, for comparison with the other parts. Rows come in the order of their bucket."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, _at(batch, "ids"), 8 * SORTED):
            key, salt = _numbers(part, "key"), _numbers(part, "salt")
            new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            if held and (key[0], salt[0]) != (_numbers(held[-1], "key")[-1], _numbers(held[-1], "salt")[-1]):
                new = np.concatenate([[0], new])
            if size >= SORTED and len(new):
                if new[0]:
                    held.append(part.slice(0, new[0]))
                yield from _sort(held)
                held, size = [], 0
                part = part.slice(new[0])
            held.append(part)
            size += spans(part.column(_at(part, "ids")))[0][-1] // 8
    if held:
        yield from _sort(held)


def _sort(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    part = rows.to_batches()[0]
    offsets, raw = spans(part.column(_at(part, "ids")))
    ids = raw.view(np.int64) if raw.flags.aligned and len(raw) % 8 == 0 else np.frombuffer(raw.tobytes(), np.int64)
    n = np.diff(offsets) // 8
    row = np.repeat(np.arange(len(n)), n)
    key, h1, h2, first, salts = (_numbers(part, c) for c in ("key", "h1", "h2", "first", "salts"))
    begin = np.cumsum(n) - n
    order = np.argsort(ids)
    of = row[order]
    same = (ids[order][1:] == ids[order][:-1]) & (key[of][1:] == key[of][:-1])
    twice = np.zeros(len(ids), bool)
    twice[order[1:][same]] = True
    one = ~np.concatenate([[False], same])  # of each string the first in this order
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids), bool)
    edge[begin[n > 0]] = True
    starts = np.flatnonzero(twice & (edge | ~np.concatenate([[False], twice[:-1]])))
    after = np.append(edge[1:], True)
    ends = np.flatnonzero(twice & (after | ~np.append(twice[1:], False)))
    if len(starts):
        of = row[starts]
        empty = pa.nulls(len(starts), pa.int64())
        yield _batch(FOUND, h1[of], h2[of], first[of] + starts - begin[of], first[of] + ends - begin[of], empty, empty)
    open_ = order[one]
    open_ = open_[salts[row[open_]] > 1]
    if len(open_):
        of = row[open_]
        at = first[of] + open_ - begin[of]
        yield _batch(FOUND, h1[of], h2[of], at, at, key[of], ids[open_])


def _removed(part: pa.RecordBatch, found: list, kept: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        part.column(_at(part, "h1")), part.column(_at(part, "h2")),
        pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array(kept, pa.binary())], names=CHANGED.names)


def _cut(length: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _at(batch, "text")):
                text = UNITS[unit](part.column(_at(part, "text")))
                offsets, raw = spans(part.column(_at(part, "text")))
                runs = part.column(_at(part, "runs"))
                at = runs.offsets.to_numpy()
                first, last = (f.to_numpy(zero_copy_only=False) for f in runs.flatten().flatten())
                at = at - at[0]
                found, kept = [], []
                for k in range(part.num_rows):
                    a, b = first[at[k]:at[k + 1]], last[at[k]:at[k + 1]] + length
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    a, b = text.places(k, a, b)
                    held = raw[offsets[k]:offsets[k + 1]]
                    gone = np.zeros(len(held) + 1, np.int8)
                    gone[a] += 1
                    gone[b] -= 1
                    kept.append(held[np.cumsum(gone[:-1]) == 0].tobytes())
                    found.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                yield _removed(part, found, kept)
    return run


def _cut_copies(length: int, unit: str):
    """Of texts with copies all goes, but for white space around the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _at(batch, "text")):
                text = UNITS[unit](part.column(_at(part, "text")))
                offsets, raw = spans(part.column(_at(part, "text")))
                long = np.flatnonzero(np.diff(text.offsets) >= length)
                found, kept = [], []
                for k in long.tolist():
                    (a,), (b,) = text.places(k, np.array([0]), np.array([text.offsets[k + 1] - text.offsets[k]]))
                    held = raw[offsets[k]:offsets[k + 1]].tobytes()
                    found.append([{"start": int(a), "end": int(b)}])
                    kept.append(held[:a] + held[b:])
                yield _removed(part.take(pa.array(long)), found, kept)
    return run


def _texts(source: DataFrame, scratch: Scratch) -> DataFrame:
    """Every different text once with the number of its copies, bucketed by its two hashes."""
    spark = source.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    texts = source.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    with cleaning(spark):
        texts.write.bucketBy(n, "h1", "h2").option("path", scratch.path("texts")).saveAsTable(name)
    scratch.tables.append(name)
    return spark.table(name)


def find_repeats(source: DataFrame, length: int, unit: str = "bytes") -> DataFrame:
    """``h1``, ``h2``, ``spans`` and ``kept`` of every different text that loses bytes."""
    prepare(source.sparkSession)
    with Scratch(source.sparkSession) as scratch:
        texts = _texts(source, scratch)
        found = staged(texts.select("text", "h1", "h2").mapInArrow(
            _find_anchors(length, unit), ANCHORS), "anchors", scratch)
        # written, so that the rows of a hot key are on the side of a join that can be split
        shared = staged(found.groupBy("key").count().where("count > 1").select(
            "key", F.ceil(F.col("count") / TOGETHER).cast("int").alias("salts")), "shared", scratch)
        runs = found.join(shared, "key").groupBy("h1", "h2").agg(
            F.collect_list(F.struct("first", "n", "key", "salts")).alias("runs"))
        refined = texts.select("text", "h1", "h2").join(runs, ["h1", "h2"]).mapInArrow(
            _refine_runs(length, unit), RUNS)
        parts = refined.repartition(F.col("key"), F.col("salt")).sortWithinPartitions("key", "salt")
        ordered = staged(parts.mapInArrow(_sort_runs, FOUND), "repeats", scratch)
        across = Window.partitionBy("key", "id")
        again = ordered.where("key is not null").withColumn("places", F.count(F.lit(1)).over(across))
        twice = ordered.where("key is null").select("h1", "h2", "first", "last").unionByName(
            again.where("places > 1").select("h1", "h2", "first", "last"))
        places = twice.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        copied = (F.col("copies") > 1) & (F.octet_length("text") >= length)
        some = texts.where(~copied).select("text", "h1", "h2").join(places, ["h1", "h2"]).mapInArrow(
            _cut(length, unit), CHANGED)
        whole = texts.where(copied).select("text", "h1", "h2").mapInArrow(_cut_copies(length, unit), CHANGED)
        return staged(some.unionByName(whole), "changed")


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int | None = None, unit: str = "bytes",
) -> DataFrame:
    """``docs`` without the bytes of repeated strings.

    Texts are UTF-8 bytes (null: empty). Adds ``spans``, the maximal runs of removed bytes (from
    ``start`` to before ``end``), and ``kept``, the bytes that remain, joined. A byte goes if it
    lies in a string of ``length`` bytes that starts a second time anywhere, be it in the same
    text, overlapping itself, or in a copy. Strings never reach from one text into the next, and
    are judged on the texts as given. ``length`` is even and at least 16 (or 4 words).

    With ``unit="words"``, ``length`` counts words between ASCII white space, whatever that space
    is. Words of such strings go, and the space between two words that go. By default strings
    have 400 bytes or 50 words.

    Texts shorter than ``length`` keep all bytes, so empty texts and tables are no special case.
    Rows are told apart by nothing: copies and repeated ids all count. Older columns of these
    names are replaced. Equality is that of two 64-bit identifiers of the string, at half and at
    the whole length; texts are the same if two 64-bit hashes are.
    """
    length = length or {"bytes": LENGTH, "words": WORDS}[unit]
    if length < UNITS[unit].least or length % 2:
        raise ValueError(f"length must be even and at least {UNITS[unit].least}")
    keep = others(docs, ["spans", "kept"])
    raw = F.coalesce(F.col(quoted(text)), F.lit(""))
    hashes = [F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2")]
    changed = find_repeats(docs.select(raw.alias("text"), *hashes), length, unit)
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), raw.alias("text"), *hashes)
    joined = rows.join(changed, ["h1", "h2"], "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("kept", F.encode("text", "utf-8")).alias("kept"))

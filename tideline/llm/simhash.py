"""Near-duplicate texts by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints link if they differ in at most three bits. Three bits cannot all lie in the same two
of three blocks without the third being untouched, and otherwise some block holds at least one of
them; either way there is a block outside of which at most two bits differ. So for each block,
every fingerprint emits all variants of the bits outside it within half of that radius: itself and
one flip. Two fingerprints that link meet in a variant, and a variant has 42 or 43 bits, so that
few others come along. Only differing fingerprints are hashed, colliding ones are verified, and a
bucket gives the links of its components instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideline.llm.batches import others, prepare, quoted, spans, staged, with_results
from tideline.llm.components import components

#: Words of a shingle and the most bits in which linked fingerprints differ.
SHINGLE = 3
BITS = 3
SEED = 42
_BLOCKS = ((0, 21), (21, 42), (42, 64))
_PAIRS = 8  # members up to which a bucket's pairs are compared at once
_CHUNK = 1 << 16
_SORTED = 1 << 19


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    words = raw.lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(size))) if len(words) >= size else iter([words])
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while h := [digest(b" ".join(run), SEED) for run in islice(runs, _CHUNK)]:
        bits = np.unpackbits(np.array(h, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(size: int):
    def make():
        def work(text: pa.Array) -> list[pa.Array]:
            offsets, raw = spans(text)
            data, at = raw.tobytes(), offsets.tolist()
            return [pa.array([fingerprint(data[a:b], size) for a, b in zip(at, at[1:])], pa.int64())]
        return work
    return make


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def balls(prints: DataFrame) -> DataFrame:
    """``key`` and ``fp``: for each block, the variants of the other bits within one flip."""
    arrays = []
    for k, (low, high) in enumerate(_BLOCKS):
        rest = [b for b in range(64) if not low <= b < high]
        flips = [0, *(_signed(1 << b) for b in rest)]
        # the block's own bits are free to hold its number
        mask = F.lit(_signed(sum(1 << b for b in rest))).cast("long")
        base = F.col("fp").bitwiseAND(mask).bitwiseOR(F.lit(k << low).cast("long"))
        arrays.append(F.array(*[base.bitwiseXOR(F.lit(x).cast("long")) for x in flips]))
    return prints.select(F.explode(F.concat(*arrays)).alias("key"), "fp")


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _tree(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the fingerprints of a bucket as far as they are linked."""
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            here = front.pop()
            near = far(rest, here) <= BITS
            for x in rest[near].tolist():
                yield int(here), x
                front.append(np.uint64(x))
            rest = rest[~near]


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    left, right = [], []
    for s in np.unique(size[size > 1]):
        if s <= _PAIRS:
            held = fp[new[size == s][:, None] + np.arange(s)]
            for i in range(1, s):
                for j in range(i):
                    near = far(held[:, i], held[:, j]) <= BITS
                    left.append(held[near, i])
                    right.append(held[near, j])
        else:
            for at in new[size == s]:
                pairs = list(_tree(fp[at:at + s]))
                left.append(np.array([x for x, _ in pairs], np.uint64))
                right.append(np.array([x for _, x in pairs], np.uint64))
    if not left:
        return (np.empty(0, np.uint64),) * 2
    a, b = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of the buckets of a partition, whose rows come in the order of their keys."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(last: bool):
        nonlocal keys, prints
        keys = np.concatenate([keys, *(k for k, _ in held)])
        prints = np.concatenate([prints, *(p for _, p in held)])
        held.clear()
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        a, b = _links(keys[:cut], prints[:cut])
        keys, prints = keys[cut:], prints[cut:]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    rows = 0
    for batch in batches:
        k, p = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "fp"))
        held.append((k, p.view(np.uint64)))
        rows += len(k)
        if rows >= _SORTED:
            yield flush(False)
            rows = 0
    if held or len(keys):
        yield flush(True)


def links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the fingerprints of ``prints`` (``fp``, no repeats) that join all
    that link, directly or over others; every link is one of at most three bits."""
    dealt = balls(prints).repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(_collide, LINKS).distinct()


RESULT = [StructField("fingerprint", StringType()), StructField("component_id", LongType())]


def group_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the SimHash of every whole text and the group it belongs to.

    Adds ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` that can be
    reached over links of at most three differing bits, its own included. Words lie between ASCII
    white space, A-Z are lower-cased, shingles are ``shingle`` words joined by spaces and count as
    often as they occur; a shorter text is one shingle. A bit is set if it is set in more than half
    of the XXH64 hashes (seed 42) of the shingles.

    A text without words, empty or null has fingerprint zero and links like any other. Copies and
    repeated ids share a fingerprint and so a group. Null ids never name a group: one of null ids
    alone has a null ``component_id``. Older columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    keep = others(docs, [f.name for f in RESULT])
    marks = staged(with_results(
        docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(doc_id)).cast("long").alias("id")),
        ["text"], ["id"], [StructField("fp", LongType())], _fingerprints(shingle)).groupBy("fp").agg(
        F.min("id").alias("first")), "fingerprints")
    reach = components(links(marks.select("fp")))
    rooted = marks.join(reach, marks.fp == reach.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = staged(rooted.join(named, "root").select("fp", "component_id"), "groups")
    whole = docs.select(
        F.col(quoted(text)).alias("text"), F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"))
    rows = with_results(whole, ["text"], ["row"], [StructField("fp", LongType())], _fingerprints(shingle))
    return rows.join(groups, "fp").select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

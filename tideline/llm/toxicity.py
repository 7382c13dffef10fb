"""Toxicity of texts: a linear classifier on character n-grams scaled by log-count ratios.

Every n-gram is a hashed feature that a text has or has not. Counting labelled texts with and
without it gives its naive Bayes log-count ratio; all features whose ratio is beyond chance, scaled
by it, are the input of a logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tideline.llm.batches import (
    BLOCKS, blocks_of, others, prepare, quoted, slices, spans, sum_blocks, with_results,
)

#: Lengths of n-grams in bytes, and bits of their hash.
LENGTHS = (4, 5, 6)
HASH_BITS = 18
#: Pseudo-documents that every feature is given in proportion to the classes.
PRIOR = 2.0
#: Features that the classifier weighs have a ratio, of either sign, of at least so many standard errors.
ERRORS = 2.5
#: Labelled texts of each class that the regression is fitted on, the first by hash of their id.
SAMPLE = 2000
_ROUNDS, _RATE, _DECAY = 300, 0.05, 1e-3
_K = np.uint64(0x9E3779B97F4A7C15)
#: Bytes and texts that are hashed at once, and what stands for no feature.
_RUN, _TEXTS, _NONE = 1 << 16, 64, 1 << HASH_BITS
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _runs(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``_RUN`` bytes, few enough to be hashed in a processor's cache.

    The number of the first, where each begins and the last ends, and a row of features for each
    length, one for every byte; ``_NONE`` where no n-gram of that length begins.
    """
    folded, ends = raw.tobytes().translate(_FOLD), offsets.tolist()
    at = 0
    while at < len(ends) - 1:
        to = min(max(at + 1, int(np.searchsorted(offsets, ends[at] + _RUN, "right")) - 1), at + _TEXTS, len(ends) - 1)
        data = np.frombuffer(
            b"\0".join([b" " + folded[a:b] + b" " for a, b in zip(ends[at:to], ends[at + 1:to + 1])]) + b"\0" * 9, np.uint8)
        n = len(data) - 8
        view, gap, found = np.ndarray(n, "<u8", data, strides=(1,)), np.flatnonzero(data[:n] == 0), np.empty((len(LENGTHS), n), np.uint64)
        for h, k in zip(found, LENGTHS):
            np.bitwise_and(view, np.uint64((1 << 8 * k) - 1), out=h)
            h += np.uint64(k)
            h *= _K
            h >>= np.uint64(64 - HASH_BITS)
            for j in range(k):
                h[gap[gap >= j] - j] = _NONE
        yield at, offsets[at:to + 1] - ends[at] + 3 * np.arange(to + 1 - at), found.view(np.int64)
        at = to


def features(offsets: np.ndarray, raw: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature for every feature of every text that ``wanted`` marks, both rising."""
    kept = np.flatnonzero(wanted)
    number = np.zeros(_NONE + 1, np.int64)
    number[kept] = np.arange(1, len(kept) + 1)  # 0: not wanted
    size, docs, found = len(kept) + 1, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, begins, h in _runs(offsets, raw):
        n = len(begins) - 1
        key = number[h]
        key += np.repeat(np.arange(n) * size, np.diff(begins))[:h.shape[1]]
        if n * size <= 16 * h.size:
            marks = np.zeros(n * size, bool)
            marks[key.ravel()] = True
            key = np.flatnonzero(marks)
        else:  # short texts, many features
            key = np.unique(key)
        key = key[key % size > 0]
        docs.append(first + key // size)
        found.append(kept[key % size - 1])
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Toxicity:
    """A fitted classifier: kept features, their scaled weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << HASH_BITS
    counts, texts = np.zeros((2, _NONE + 1), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in slices(batch, at):
            label = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            texts += np.bincount(label, minlength=2)[:2]
            for first, begins, h in _runs(*spans(part.column(at))):
                ends = begins.tolist()
                for c, a, b in zip(label[first:first + len(ends) - 1].tolist(), ends, ends[1:]):
                    counts[c][h[:, a:b].ravel()] += 1  # once, however often the text has it
    sums = np.zeros((2, size + 1))  # behind the features: the number of texts
    sums[:, :size], sums[:, size] = counts[:, :size], texts
    yield from blocks_of(sums.ravel(), TaskContext.get().partitionId())


def log_ratios(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-count ratios of all features, their standard errors, and the number of texts of each class."""
    size = 1 << HASH_BITS
    sums = sum_blocks(labelled.mapInArrow(_count, BLOCKS), 2 * (size + 1)).reshape(2, -1)
    texts = sums[:, size]
    if not texts.all():
        return np.zeros(size), np.ones(size), texts
    smooth = sums[:, :size] + PRIOR * (texts / texts.sum())[:, None]
    return np.log(smooth[1] / texts[1]) - np.log(smooth[0] / texts[0]), np.sqrt((1 / smooth).sum(0)), texts


def regress(rows: Sequence[np.ndarray], label: np.ndarray, scale: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features (numbers into ``scale``) and intercept, by Adam.

    Texts of a class weigh as much together as all labelled texts of the class.
    """
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    share = np.where(label == 1, texts[1] / max(1, (label == 1).sum()), texts[0] / max(1, (label == 0).sum()))
    share = share / share.sum()
    w, b = np.ones(len(scale)) * 0.05, float(np.log(texts[1] / texts[0]))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, _ROUNDS + 1):
        z = b + np.bincount(doc, weights=(w * scale)[col], minlength=len(rows))
        off = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.append(np.bincount(col, weights=off[doc], minlength=len(scale)) * scale + _DECAY * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = _RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, b


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Toxicity:
    """Fit a classifier on the documents that ``labels`` marks and that satisfy ``train``.

    ``train`` is a condition on ``doc_id``. Ratios come from all such documents, the regression from
    at most ``SAMPLE`` labels of each class. Every feature whose ratio is at least
    ``ERRORS`` standard errors gets a weight. Labels other than 0 and 1, labels without a document
    and null ids teach nothing; a document counts once for each of its labels. If a class is
    missing, all texts get the share of the class that is there.
    """
    prepare(docs.sparkSession)
    marks = labels.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label")).where(
        train & F.col("label").isin(0, 1))
    texts_of = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    # the same join at every size, also where the labels are few enough to be broadcast
    ratio, error, texts = log_ratios(texts_of.where(train).join(marks.hint("merge"), "doc_id").select("text", "label"))
    if not texts.all():
        share = texts[1] / texts.sum() if texts.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Toxicity(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    kept = np.flatnonzero(np.abs(ratio) >= ERRORS * error)
    wanted = np.zeros(1 << HASH_BITS, bool)
    wanted[kept] = True

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                doc, f = features(*spans(part.column(at)), wanted)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("label")),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.searchsorted(kept, f), pa.int32())),
                ], names=["label", "found"])

    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = marks.where("label = 0").orderBy(*order).limit(SAMPLE).unionByName(
        marks.where("label = 1").orderBy(*order).limit(SAMPLE))
    sample = texts_of.join(F.broadcast(few), "doc_id").select("text", "label").mapInArrow(some, StructType([
        StructField("label", IntegerType()), StructField("found", ArrayType(IntegerType()))])).toArrow()
    found = sample.column("found").combine_chunks()
    ends = found.offsets.to_numpy()
    flat = found.flatten().to_numpy(zero_copy_only=False)
    rows = [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:])]
    order_of = sorted(range(len(rows)), key=lambda k: (rows[k].tobytes(), sample.column("label")[k].as_py()))
    label_of = sample.column("label").to_numpy()
    weights, intercept = regress([rows[k] for k in order_of], label_of[order_of], ratio[kept], texts)
    return Toxicity(kept, weights, intercept)


RESULT = [StructField("score", DoubleType())]


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a whole text is toxic.

    Empty and null texts get what the intercept says. Rows are scored one by one, so repeated rows
    stay; an older column ``score`` is replaced.
    """
    def make():
        weight = np.zeros(1 << HASH_BITS)
        weight[model.features] = model.weights
        wanted = weight != 0

        def work(column: pa.Array) -> list[pa.Array]:
            doc, f = features(*spans(column), wanted)
            z = model.intercept + np.bincount(doc, weights=weight[f], minlength=len(column))
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
        return work

    return with_results(docs, [text], others(docs, ["score"]), RESULT, make)

"""Masked pseudo-likelihood: how well each token of a text is predicted from both its sides.

A small network sees the two tokens before and the two after a masked one: their embeddings, one
table for each place, are added and squashed, and the result predicts first the class of the
masked token and then the token within its class, so that probabilities are exact and cheap. The
score of a text is the sum of the log-probabilities of all its tokens, each given its neighbours.

Tokens are the most frequent words of the corpus; rarer words share hashed tokens. The network gives
the probability of such a token, and a Spark table with the count of every word, which grows with the
corpus, that of the word among the words of its token (Witten-Bell): in proportion to its count,
with a share for words never counted, which are spelled out byte by byte. Tasks are given the counts of
a fixed number of words; the few occurrences of all others are joined to the table. In training each position
of every text is masked once. Each task trains a copy of the network on its rows, and the copies are averaged
by Spark, weighted by positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from tideline.llm.batches import (
    BLOCKS, blocks_of, others, prepare, quoted, slices, staged, sum_blocks, with_results,
)

#: Classes, and tokens of a class; of all tokens so many are for hashed words; one is the edge of a text.
CLASSES, SIZE, HASHED = 64, 64, 1024
TOKENS = CLASSES * SIZE
FIRST = TOKENS - HASHED
#: Places around a masked token, and the width of the network.
PLACES, WIDTH = (-2, -1, 1, 2), 16
#: Positions of a step of training; step size; weights are held so that no logit leaves the range of floats.
STEP, RATE, LARGEST = 4096, 1.0, 2.0
#: The counts of so many of the most frequent words are given to every task; those of others are joined.
KNOWN = 1 << 18
#: Rows of shares that are raised at once; bytes of texts whose words are looked up at once.
_ROWS, _SLICE = 1024, 8 << 20


class Network:
    """Parameters in one vector, in parts: embeddings, classes, tokens within classes."""

    SHAPES = ((len(PLACES), TOKENS, WIDTH), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, SIZE), (CLASSES, SIZE))
    LENGTH = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.float32)
        self.parts = self._cut(self.values)
        # reused by all steps: a place for inputs and a one, shares of classes and of tokens within, scaled weights
        self.inputs = np.ones((STEP, WIDTH + 1), np.float32)
        self.shares = np.empty((STEP, 2, SIZE), np.float32)
        self.scaled = np.empty((CLASSES + 1, WIDTH + 1, SIZE), np.float32)

    @classmethod
    def _cut(cls, values: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])
        return [values[e - int(np.prod(s)):e].reshape(s) for e, s in zip(ends, cls.SHAPES)]

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random embeddings; biases that predict every token by its frequency."""
        net = cls(np.random.default_rng(7).normal(0, 0.05, cls.LENGTH))
        share = (counts + 1).reshape(CLASSES, SIZE)
        net.parts[2][:] = np.log(share.sum(1) / share.sum())
        net.parts[4][:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the neighbours say, and a one that is multiplied by biases; good until the next call."""
        total = self.parts[0][0].take(ids[at + PLACES[0]], axis=0)
        for k, place in enumerate(PLACES[1:], 1):
            total += self.parts[0][k].take(ids[at + place], axis=0)
        h = self.inputs[:len(at)]
        np.tanh(total, out=h[:, :WIDTH])
        return h

    def _positions(self, ids: np.ndarray, at: np.ndarray):
        """The order of positions by token, their tokens in it, and where each class ends."""
        target = ids[at]
        order = np.argsort(target, kind="stable")
        target = target[order]
        ends = np.searchsorted(target, np.arange(0, TOKENS + 1, SIZE)).tolist()
        return order, target, [(c, slice(i, j)) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]

    def _scale(self) -> None:
        """Weights and biases of which a product gives ``logit / 1024``, those of the classes last."""
        _, cw, cb, tw, tb = self.parts
        for out, weights, biases in ((self.scaled[:-1], tw, tb), (self.scaled[-1], cw, cb)):
            np.multiply(weights, 1 / 1024, out=out[..., :WIDTH, :])
            np.multiply(biases, 1 / 1024, out=out[..., WIDTH, :])

    def _predict(self, h: np.ndarray, target: np.ndarray, classes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of all classes (even rows), and of all tokens within the class of each row (odd rows), before
        division by their sums; these sums; and where in the shares the targets are. Good until the next call."""
        shares = self.shares[:len(h)]
        np.matmul(h, self.scaled[-1], out=shares[:, 0])
        for c, rows in classes:
            np.matmul(h[rows], self.scaled[c], out=shares[rows, 1])
        shares = _raised(shares.reshape(-1, SIZE))
        hit = np.arange(0, shares.size, SIZE).reshape(-1, 2)
        hit[:, 0] += target // SIZE
        hit[:, 1] += target % SIZE
        return shares, shares @ _ONES, hit.ravel()

    def log_probability(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, ids = np.empty(len(at)), ids.astype(np.uint16)
        self._scale()
        for k in range(0, len(at), STEP):
            here = at[k:k + STEP]
            order, target, classes = self._positions(ids, here)
            shares, total, hit = self._predict(self.hidden(ids, here[order]), target, classes)
            out[k + order] = np.log(shares.ravel()[hit] / total).reshape(-1, 2).sum(1)
        return out

    def train(self, ids: np.ndarray, at: np.ndarray, seen: list[np.ndarray]) -> None:
        """A step of Adagrad for every ``STEP`` positions; ``seen`` holds its sums of squares."""
        embed, cw, cb, tw, tb = self.parts
        ids = ids.astype(np.uint16)
        inner = np.empty((CLASSES, WIDTH + 1, SIZE), np.float32)
        room = [np.empty(tw.shape, np.float32) for _ in range(2)]
        for k in range(0, len(at), STEP):
            order, target, classes = self._positions(ids, at[k:k + STEP])
            here, n = at[k:k + STEP][order], len(order)
            h = self.hidden(ids, here)
            self._scale()
            shares, total, hit = self._predict(h, target, classes)
            shares *= (1 / (n * total))[:, None]
            shares.ravel()[hit] -= np.float32(1 / n)
            p, q = shares[::2], shares[1::2]
            back, inside = p @ cw.T, np.empty((n, WIDTH), np.float32)
            inner.fill(0)
            for c, rows in classes:
                np.matmul(q[rows], tw[c].T, out=inside[rows])
                np.matmul(h[rows].T, q[rows], out=inner[c])
            back += inside
            outer = h.T @ p
            back *= 1 - h[:, :WIDTH] ** 2
            for part, sums, g in zip((cw, cb, tw, tb), seen[1:], (
                    outer[:WIDTH], outer[WIDTH], inner[:, :WIDTH], inner[:, WIDTH])):
                one, two = (r.ravel()[:g.size].reshape(g.shape) for r in room)
                np.multiply(g, g, out=one)
                sums += one
                np.sqrt(sums, out=one)
                one += 1e-6
                np.divide(g, one, out=two)
                two *= RATE
                part -= two
            np.clip(cw, -LARGEST, LARGEST, out=cw)
            np.clip(tw, -LARGEST, LARGEST, out=tw)
            for place, offset in enumerate(PLACES):
                token = ids[here + offset]
                order = np.argsort(token, kind="stable")
                token = token[order]
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                which = token[first].astype(np.int64)
                # two columns are summed as one of complex numbers
                g = np.add.reduceat(back.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
                sums = seen[0][place].take(which, axis=0)
                sums += g * g
                _rows(seen[0][place])[which] = _rows(sums)
                np.sqrt(sums, out=sums)
                sums += 1e-6
                g *= RATE
                g /= sums
                _rows(embed[place])[which] = _rows(embed[place].take(which, axis=0) - g)


def _rows(table: np.ndarray) -> np.ndarray:
    """The rows of a table as single values, which are stored faster."""
    return table.view(f"V{table.itemsize * table.shape[1]}").ravel()


_ONES = np.ones(SIZE, np.float32)
assert CLASSES == SIZE


def _raised(small: np.ndarray) -> np.ndarray:
    """``(1 + small) ** 1024`` in place, a few rows at a time, so that they stay in the processor's cache.

    With ``x / 1024`` that is close to the exponential of ``x`` and several times as fast. What is divided by
    its sum is this function, so that probabilities still add up to one.
    """
    for k in range(0, len(small), _ROWS):
        rows = small[k:k + _ROWS]
        rows += 1  # not part of the product, as a bias would be rounded with it
        for _ in range(10):
            np.square(rows, out=rows)
    return small


class Tokens:
    """Words (as bytes) to numbers: 0 is the edge of a text, then come the known words, then those of one slice."""

    def __init__(self, words: list[bytes]):
        self.words = pa.array(words, pa.binary())
        hashed = [FIRST + crc32(w) % HASHED for w in words[FIRST - 1:]]
        self.known = np.concatenate([np.arange(min(FIRST, len(words) + 1)), hashed]).astype(np.uint16)

    @staticmethod
    def split(column: pa.Array) -> pa.ListArray:
        """The words of every text between ASCII white space, A-Z lower-cased, as bytes; null has none."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
        words, ends = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy()
        full = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty part
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(before[ends - ends[0]], pa.int32()), words.filter(full))

    def of(self, words: pa.ListArray | list[list[bytes]]) -> tuple[
            np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Numbers and tokens of all texts with two edges before and after each; where words are, and of which
        text; and the words that are not known, which are numbered for this call alone."""
        if isinstance(words, list):
            words = pa.array(words, pa.list_(pa.binary()))
        count, flat = np.diff(words.offsets.to_numpy()), words.flatten()
        doc = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(doc)) + 2 + 2 * doc
        number = np.zeros(len(doc) + 2 * len(count) + 2, np.int64)
        found = pc.index_in(flat, self.words)
        number[at] = found.fill_null(0).to_numpy() + 1
        rare = flat.filter(found.is_null()).dictionary_encode()
        number[at[found.is_null().to_numpy(zero_copy_only=False)]] = rare.indices.to_numpy() + len(self.known)
        new = rare.dictionary.to_pylist()
        token = np.concatenate([self.known, np.array([FIRST + crc32(w) % HASHED for w in new], np.uint16)])
        return number, token[number], at, doc, new


#: Words and how often they occur in a batch of texts.
_COUNTS = StructType([StructField("word", BinaryType()), StructField("n", LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = Tokens.split(batch.column(0)).flatten().value_counts().flatten()
        yield pa.RecordBatch.from_arrays([words, n], names=_COUNTS.names)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes of all words, a line feed before and after each, and where a word begins."""
    raw = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
    return raw[:-1] * 256 + raw[1:], np.flatnonzero(raw[:-1] == 10)


@dataclass
class Rare:
    """What is known of the words that share hashed tokens."""

    #: ``word`` (as bytes) and ``count`` of every word that is not among the known ones.
    counts: DataFrame
    #: Occurrences and different words of each hashed token, log-probabilities of a byte after another.
    number: np.ndarray
    kinds: np.ndarray
    spelling: np.ndarray


def _spelled(words: list[bytes], token: np.ndarray, kinds: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """Logarithms of the counts that the words have before any is counted."""
    if not words:
        return np.empty(0)
    pairs, first = _letters(words)
    return np.log(np.maximum(1, kinds[token - FIRST])) + np.add.reduceat(spelling[pairs], first)


def _gather(top: list[bytes]):
    """Sums over counted words: occurrences and kinds of each hashed token, pairs of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = set(top)
        total = np.zeros(2 * HASHED + (1 << 16))
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            total[2 * HASHED:] += np.bincount(_letters(words)[0], minlength=1 << 16)
            rest = np.array([w not in head for w in words])
            token = np.array([crc32(w) % HASHED for w in words])[rest]
            total[:HASHED] += np.bincount(token, batch.column(1).to_numpy()[rest], HASHED)
            total[HASHED:2 * HASHED] += np.bincount(token, minlength=HASHED)
        yield from blocks_of(total, TaskContext.get().partitionId())
    return run


@dataclass
class Model:
    #: Known words, the most frequent first, and how often they occur; the first ``FIRST - 1`` are tokens.
    words: list[bytes]
    counts: np.ndarray
    values: np.ndarray
    rare: Rare


def _train(words: list[bytes], values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, net = Tokens(words), Network(values)
        seen = Network._cut(np.full(Network.LENGTH, 1e-3, np.float32))
        trained = 0
        for batch in batches:
            # words are looked up for the whole batch, as that prepares all known words again
            _, ids, at, doc, _ = tokens.of(tokens.split(batch.column(0)))
            ends = np.cumsum([part.num_rows for part in slices(batch, 0)])
            for where in np.split(at, np.searchsorted(doc, ends[:-1])):
                net.train(ids, where, seen)
            trained += len(at)
        if trained:
            yield from blocks_of(
                np.append(net.values.astype(np.float64) * trained, trained), TaskContext.get().partitionId())
    return run


def _known(counted: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """The most frequent words, ``most`` of them or fewer, their counts, and the table of all other words.

    Counts are put into bands, eight to a power of two, and whole bands are known, so that no words
    are sorted by Spark; a band that does not fit is left to the join.
    """
    band = F.floor(F.log2("count") * 8)
    lowest, total = None, 0
    for r in sorted(counted.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            break
        lowest = r["band"]
    if lowest is None:
        return [], np.zeros(0), counted
    rows = sorted((-r["count"], bytes(r["word"])) for r in counted.where(band >= lowest).collect())
    return [w for _, w in rows], np.array([-n for n, _ in rows], float), counted.where(band < lowest)


def learn_model(docs: DataFrame, text: str = "text", known: int = KNOWN) -> Model:
    """Words and network learned from the whole texts of all rows of ``docs``.

    The words of a text lie between ASCII white space, A-Z are lower-cased. All words are counted
    by Spark and stay in a table; equally frequent ones are taken in their order. At most ``known`` of them, which
    bounds what a task is given and changes no result but by rounding, are collected. Empty and null texts teach
    nothing, and without any words all tokens are equally likely. Copies of the network are averaged, so
    the result depends a little on how rows are dealt to tasks.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    counted = staged(texts.mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("n").alias("count")), "words")
    words, count, rest = _known(counted, max(known, FIRST - 1))
    top = words[:FIRST - 1]
    sums = sum_blocks(counted.mapInArrow(_gather(top), BLOCKS), 2 * HASHED + (1 << 16))
    number, kinds, pairs = np.split(sums, [HASHED, 2 * HASHED])
    pairs = pairs.reshape(256, 256) + 1
    rare = Rare(rest, number, kinds, np.log(pairs / pairs.sum(1, keepdims=True)).ravel())
    counts = np.zeros(TOKENS)
    counts[1:1 + len(top)] = count[:len(top)]
    counts[FIRST:] = number
    values = Network.fresh(counts).values
    total = sum_blocks(texts.mapInArrow(_train(words, values), BLOCKS), Network.LENGTH + 1)
    if total[-1]:
        values = (total[:-1] / total[-1]).astype(np.float32)
    return Model(words, count, values, rare)


RESULT = [
    StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType()),
    StructField("word_log_likelihood", DoubleType())]


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the pseudo-likelihood of every whole text.

    Adds ``n_tokens``, ``log_likelihood``, the sum of the log-probabilities of all tokens given
    their neighbours, and ``word_log_likelihood``, that of all words: the same, and for rare words
    their log-probability among the words of their token. A text without words, or null, has 0 of all. Rows are scored one by one, so
    repeated rows stay; older columns of these names are replaced.
    """
    known, count, values, rare = model.words, model.counts, model.values, model.rare
    kinds, spelling = rare.kinds, rare.spelling
    all_of = np.log(rare.number + np.maximum(1, kinds))
    token = np.array([FIRST + crc32(w) % HASHED for w in known[FIRST - 1:]], np.int64)
    among = np.concatenate([np.zeros(min(FIRST, len(known) + 1)), np.logaddexp(
        np.log(count[FIRST - 1:]), _spelled(known[FIRST - 1:], token, kinds, spelling)) - all_of[token - FIRST]])

    def make():
        tokens, net = Tokens(known), Network(values)

        def work(column: pa.Array) -> list[pa.Array]:
            number_of, ids, at, doc, new = tokens.of(tokens.split(column))
            n, word = len(column), number_of[at]
            token = np.array([FIRST + crc32(w) % HASHED for w in new], np.int64)
            spelled = _spelled(new, token, kinds, spelling)
            each = net.log_probability(ids, at)
            unknown = np.flatnonzero(word >= len(among))
            which = word[unknown] - len(among)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[unknown], minlength=n))]), pa.int32())
            return [
                pa.array(np.bincount(doc, minlength=n), pa.int64()),
                pa.array(np.bincount(doc, weights=each, minlength=n), pa.float64()),
                pa.array(np.bincount(doc, weights=each + np.concatenate([among, -all_of[token - FIRST]])[word],
                                     minlength=n), pa.float64()),
                pa.ListArray.from_arrays(ends, pa.array(new, pa.binary()).take(pa.array(which))),
                pa.ListArray.from_arrays(ends, pa.array(spelled[which], pa.float32()))]
        return work

    keep = others(docs if keep is None else docs.select(*map(quoted, keep)), [f.name for f in RESULT])
    row = docs.select(F.col(quoted(text)).alias("text"), F.struct(
        F.lit(0).alias("none"), *[F.col(quoted(c)) for c in keep]).alias("row"))
    lists = [StructField("words", ArrayType(BinaryType())), StructField("spelled", ArrayType(FloatType()))]
    scored = staged(with_results(row, ["text"], ["row"], [*RESULT, *lists], make, _SLICE).withColumn(
        "id", F.monotonically_increasing_id()), "scored")
    unknown = scored.select("id", F.explode(F.arrays_zip("words", "spelled")).alias("w")).select(
        "id", F.col("w.words").alias("word"), F.col("w.spelled").alias("spelled"))
    # written, so that the words' shuffle files are gone when the texts are dealt
    counted = staged(unknown.join(rare.counts, "word", "left").groupBy("id").agg(F.sum(F.when(
        F.col("count").isNull(), F.col("spelled")).otherwise(
        F.log(F.col("count") + F.exp("spelled")))).alias("more")), "rare-words")
    # built from the sums, so that no text is sorted
    return scored.join(counted.hint("shuffle_hash"), "id", "left").select(
        *[F.col("row").getField(c).alias(c) for c in keep], "n_tokens", "log_likelihood",
        (F.col("word_log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("word_log_likelihood"))

"""Spelling variants of a vocabulary by composing finite-state machines.

Two words are near if one inserted, deleted or replaced code point turns one into the other. With
the vocabulary as an acceptor, near words are the pairs that the composition of the acceptor, a
transducer of exactly one edit, and the acceptor again accepts.

The composition is never built whole. A pair whose shorter word has ``m`` code points shares the
first half of them, or else the last half. So words are dealt by ``m`` and the half that is kept:
all words of a partition drive the composed machine into one state, which is its initial state.
A task builds the minimised acceptors of what follows that state, composes them and enumerates
the accepted pairs. A partition of too many letters is dealt once more, by half of the rest,
until the rest is a single code point; so none is unbounded, whatever the words have in common.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideline.llm.batches import prepare, quoted, slices, spans, staged
from tideline.session import Scratch

#: Code points of the shortest word, and how much more frequent a word's form is.
SHORTEST, RATIO = 6, 5
#: Letters that follow the initial state of a partition; one of more is dealt again.
LETTERS = 100_000
#: Different words that a task counts before it passes them on.
COUNTED = 300_000

COUNTS = StructType([StructField("word", StringType()), StructField("n", LongType())])


def _count(shortest: int, numbered: bool, misprint: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=COUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                offsets, raw = spans(part.column(part.schema.get_field_index("text")))
                data, at = raw.tobytes().lower(), offsets.tolist()  # of bytes: A-Z only
                ids = part.column(part.schema.get_field_index("id")).to_pylist() if numbered else ()
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    found = Counter(runs.findall(data[a:b].decode("utf-8", "replace")))
                    if not numbered:
                        counts.update(found)
                        continue
                    start = crc32(f"{'' if ids[k] is None else ids[k]}:".encode())
                    for word, n in found.items():
                        h = crc32(word.encode(), start)
                        if h % misprint == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1:]
                            if len(word) < shortest:
                                continue
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)
    return run


def count_words(
    docs: DataFrame, text: str = "text", shortest: int = SHORTEST, doc_id: str | None = None, misprint: int = 0,
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all whole texts, for words of ``shortest`` code points
    or more. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.

    With ``doc_id`` and ``misprint``, one word and document in ``misprint`` loses a code point,
    so that variants are known to exist: where it divides h, the CRC-32 of ``<doc_id>:<word>``,
    the code point h modulo the length goes (a null id is an empty one).

    Null and empty texts have no words; repeated rows count every time; other columns are ignored.
    Counts are summed in the tasks first, so that a frequent word is one row of each.
    """
    prepare(docs.sparkSession)
    numbered = doc_id is not None and misprint > 0
    columns = [F.col(quoted(text)).alias("text"), *([F.col(quoted(doc_id)).cast("long").alias("id")] if numbered else [])]
    counted = docs.select(*columns).mapInArrow(_count(shortest, numbered, misprint), COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal deterministic acceptor of sorted different strings of one length.

    States are numbers; ``arcs`` has a dict from symbol to state for each, ``words`` how many
    strings it leads to. States are shared as soon as no later string can change them.
    """

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.words: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]
        last = ""
        for s in strings:
            keep = 0
            while keep < len(last) and s[keep] == last[keep]:
                keep += 1
            self._close(path, last, keep)
            path.extend({} for _ in range(len(s) - keep))
            last = s
        self._close(path, last, 0)
        self.start = self._state(path[0])

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())  # strings come sorted, and so do the arcs of a state
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.words.append(sum(self.words[to] for to in arcs.values()) if arcs else 1)
        return state

    def _close(self, path: list[dict[str, int]], last: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(path.pop())
            path[-1][last[len(path) - 1]] = state


Path = tuple  # of the path before and a symbol; () is the empty one


def _text(path: Path) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


class Composition:
    """Acceptor, exactly one edit, acceptor: the pairs of strings that it accepts.

    Before the edit both machines read the same symbols, and after it they do again; what they
    still accept together depends on their two states alone, and is found once for each two.
    """

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self._common: dict[tuple[int, int], list[str]] = {}

    def common(self, a: int, b: int) -> list[str]:
        """Strings that are accepted from both states."""
        found = self._common.get((a, b))
        if found is None:
            found, ways = [], [(a, b, ())]
            left, right = self.left.arcs, self.right.arcs
            while ways:
                s, t, path = ways.pop()
                here, there = left[s], right[t]
                if not here and not there:
                    found.append(_text(path))
                    continue
                for c, to in here.items():
                    if c in there:
                        ways.append((to, there[c], (path, c)))
            self._common[a, b] = found
        return found

    def replaced(self) -> Iterator[tuple[str, str]]:
        """Pairs with one symbol replaced, of an acceptor with itself; the smaller string first."""
        arcs, words = self.left.arcs, self.left.words
        ways: list[tuple[int, Path]] = [(self.left.start, ())]
        while ways:
            state, path = ways.pop()
            out = list(arcs[state].items())
            for k, (d, there) in enumerate(out):
                for c, here in out[:k]:
                    for rest in self.common(here, there):
                        before = _text(path)
                        yield before + c + rest, before + d + rest
                if words[there] > 1:
                    ways.append((there, (path, d)))

    def inserted(self) -> Iterator[tuple[str, str]]:
        """Pairs of a string on the left and one with a symbol more on the right, perhaps repeated."""
        left, right = self.left.arcs, self.right.arcs
        ways: list[tuple[int, int, Path]] = [(self.left.start, self.right.start, ())]
        while ways:
            s, t, path = ways.pop()
            for d, there in right[t].items():
                for rest in self.common(s, there):
                    before = _text(path)
                    yield before + rest, before + d + rest
                if d in left[s]:
                    ways.append((left[s][d], there, (path, d)))


def near_pairs(short: list[str], long: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs within ``short`` and between ``short`` and ``long``, strings of a symbol more."""
    one = Acceptor(sorted(short))
    yield from Composition(one, one).replaced()
    if long:
        yield from set(Composition(one, Acceptor(sorted(long))).inserted())


def met_first(a: str, b: str, m: int, head: int, tail: int) -> bool:
    """Whether two near words are this partition's: another one that holds both leaves them to it."""
    same = 0
    while same < m and a[same] == b[same]:
        same += 1
    x = y = 0
    while x + y < head + tail:
        half = (m - x - y) // 2
        if same >= x + half:
            x += half
        else:
            y += half
    return (x, y) == (head, tail)


NEAR = StructType([StructField("word", StringType()), StructField("near", StringType()), StructField("near_n", LongType())])
_KEYS = ("m", "head", "tail", "before", "after")


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of the partitions whose words come one after the other."""
    now: tuple | None = None
    held: dict[str, int] = {}
    out: tuple[list, list, list] = ([], [], [])

    def close() -> None:
        m, head, tail, before, after = now
        short = [w[head:len(w) - tail] for w in held if len(w) == m]
        if not short or len(held) < 2:
            return
        for a, b in near_pairs(short, [w[head:len(w) - tail] for w in held if len(w) > m]):
            a, b = before + a + after, before + b + after
            if met_first(a, b, m, head, tail):
                for column, values in zip(out, ((a, b), (b, a), (held[b], held[a]))):
                    column.extend(values)

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=NEAR.names)
        for column in out:
            column.clear()
        return made

    for batch in batches:
        columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_KEYS, "word", "n")}
        for key, word, n in zip(zip(*(columns[c] for c in _KEYS)), columns["word"], columns["n"]):
            if key != now:
                if now is not None:
                    close()
                now, held = key, {}
            held[word] = n
        if len(out[0]) >= 10_000:
            yield rows()
    if now is not None:
        close()
    yield rows()


def _kept(words: DataFrame) -> DataFrame:
    """With the shared first and last code points of each word's partition."""
    return words.withColumns({
        "before": F.expr("left(word, head)"), "after": F.expr("right(word, tail)")})


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word``, ``near`` and ``near_n`` of every two near words, both ways and each once.

    ``words`` has different words of at least two code points (``word``, ``n``).
    """
    size = F.char_length("word")
    # the shorter word of a pair has as many code points as this one, or one less
    dealt = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 1").withColumns(
        {"head": F.lit(0), "tail": F.lit(0)})
    found, here = [], dealt
    while True:
        half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
        halves = here.withColumn("half", half).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        here = staged(_kept(halves.select(
            "word", "n", "m", (F.col("head") + F.col("half") * (1 - F.col("side"))).alias("head"),
            (F.col("tail") + F.col("half") * F.col("side")).alias("tail"))), "halves", scratch)
        rest = F.col("m") - F.col("head") - F.col("tail")
        large = staged(here.where(rest > 1).groupBy(*_KEYS).agg(F.sum(rest).alias("letters")).where(
            F.col("letters") > LETTERS).select(*_KEYS), "large", scratch)
        some = not large.isEmpty()
        small = here.join(large, list(_KEYS), "left_anti") if some else here
        ordered = small.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        found.append(staged(ordered.mapInArrow(_compose, NEAR), "near", scratch))
        if not some:
            break
        here = here.join(large, list(_KEYS), "left_semi").select("word", "n", "m", "head", "tail")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``up``; every round doubles how far a word looks.

    Counts grow by a factor with every link, so that there are no circles, and few rounds.
    """
    links = staged(links, "roots", scratch)
    while True:
        above = links.select(F.col("word").alias("at"), F.col("up").alias("next"))
        step = staged(links.join(above, F.col("up") == F.col("at"), "left").select(
            "word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots", scratch)
        links = step.select("word", "up")
        if step.where("moved").isEmpty():
            return links.withColumnRenamed("up", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (``word``, ``n``) with the form that each is taken for a variant of.

    Adds ``n_near``, how many words are near; ``form``, the near word of the largest ``n`` (of
    several the smallest in code-point order) and its ``form_n``, both null unless that is at
    least ``ratio`` (2 or more) times the word's own; and ``root``, the word reached by following
    forms to the last one, the word itself if it has none.

    Words are different, not null, and have at least two code points; counts are positive. Other
    columns are ignored. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, else forms may run in circles")
    spark = words.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        words = staged(words.select("word", F.col("n").cast("long").alias("n")), "words", scratch)
        best = near_words(words, scratch).groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        enough = -F.col("best.less") >= ratio * F.col("n")
        told = staged(words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n")), "forms", scratch)
        roots = _roots(told.where("form is not null").select("word", F.col("form").alias("up")), scratch)
        return staged(told.join(roots, "word", "left").select(
            "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")

"""Periodic runs of words by uniting suffix classes in the order of descending LCP.

A run is a stretch of words that repeats with a period at least twice and cannot be extended. The
suffixes of a text are sorted; neighbours with a common prefix of ``l`` words are edges of weight
``l``. Edges are taken by decreasing weight, as in Kruskal's algorithm: union-find classes hold the
suffixes that agree in ``l`` words, as ordered sets of positions. If two positions become
neighbours in a set and lie at most ``l`` words apart, their distance is the smallest period of
the stretch from the first of them to ``l`` words after the second, which ends there. It is a run
unless it can be extended to the left, and then the run is seeded by an earlier position.

Runs of ``least`` words or more only have seeds that agree in half as many. Positions whose words
up to there occur once in their text are left out before sorting, which are nearly all in prose.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tideline.llm.batches import others, spans, with_results

#: Words of the shortest run.
LEAST = 12
_A, _B, _R = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(31)


def suffixes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of their suffixes, and the LCP of each with the next one.

    ``words`` are numbers of words followed by a number of its own. Prefix doubling: a level ranks
    all positions by twice as many words as the one before. The levels are kept to read the LCP
    off them, from the longest to the shortest.
    """
    n = len(words)
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < n:
        rank = levels[-1]
        if len(np.unique(rank[at])) == len(at):
            break
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = at[np.argsort(levels[-1][at], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def seeds(order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """First position, period and common words of all pairs that become neighbours at a distance
    within their LCP, in the order of decreasing LCP."""
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent = list(range(len(order)))
    sets: list[list[int] | None] = [[p] for p in order.tolist()]
    after: dict[int, int] = {}  # the next position of its set, as last seen
    found = []
    weights = lcp[edges].tolist()
    at, places = 0, edges.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    while at < len(places):
        weight = weights[at]
        touched: list[tuple[int, int]] = []  # a suffix of the class and a position put into its set
        while at < len(places) and weights[at] == weight:
            a, b = root(places[at]), root(places[at] + 1)
            at += 1
            if len(sets[a]) < len(sets[b]):
                a, b = b, a
            parent[b], into, small = a, sets[a], sets[b]
            sets[b] = None
            if 8 * len(small) > len(into):
                into.extend(small)
                into.sort()
            else:
                for p in small:
                    into.insert(bisect_left(into, p), p)
            touched.extend((a, p) for p in small)
        for a, p in touched:  # neighbours once all edges of this weight are in
            into = sets[root(a)]
            k = bisect_left(into, p)
            for i, j in zip(into[max(0, k - 1):k + 1], into[max(1, k):k + 2]):
                if after.get(i) != j:  # else they have more words in common
                    after[i] = j
                    if j - i <= weight:
                        found.append((i, j - i, weight))
    return found


def runs_of(words: np.ndarray, at: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of one sequence, by start and then period.

    ``at`` has all positions whose next ``least // 2`` words occur twice or more.
    """
    if len(at) < 2:
        return []
    order, lcp = suffixes(np.append(words, words.max() + 1), at)
    return sorted(
        (i, p + same, p) for i, p, same in seeds(order, lcp, max(1, least // 2))
        if p + same >= least and (i == 0 or words[i - 1] != words[i + p - 1]))


def _repeated(words: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose ``gram`` words occur at another position of the same text. Hashes may let
    through a few more, never less."""
    n = len(words) - gram + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = (doc[:n].astype(np.uint64) + np.uint64(1)) * _B
    for k in range(gram):
        h = (h ^ words[k:k + n].astype(np.uint64)) * _A
        h ^= h >> _R
    inside = np.flatnonzero(doc[:n] == doc[gram - 1:])
    h = h[inside]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return inside[twice]


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
RESULT = [StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
_KIND = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))


def _find(least: int):
    gram = max(1, least // 2)

    def make():
        def work(text: pa.Array) -> list[pa.Array]:
            offsets, raw = spans(text)
            data, at = raw.tobytes(), offsets.tolist()
            split = [data[a:b].split() for a, b in zip(at, at[1:])]  # of bytes: ASCII white space
            known: dict[bytes, int] = {}
            sizes = np.array([len(w) for w in split], np.int64)
            begin = np.cumsum(sizes) - sizes
            ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(split)), sizes)
            candidates = _repeated(ids, doc, gram)
            bounds = np.searchsorted(candidates, np.append(begin, begin[-1] + sizes[-1]) if len(split) else [0])
            found, kept = [], []
            for k, words in enumerate(split):
                here = candidates[bounds[k]:bounds[k + 1]] - begin[k]
                runs = runs_of(ids[begin[k]:begin[k] + sizes[k]], here, least) if len(here) > 1 else []
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in runs:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                found.append([dict(zip(RUN.names, run)) for run in runs])
                kept.append(b" ".join(words))
            return [pa.array(found, _KIND), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)]
        return work
    return make


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the periodic runs of every whole text.

    Adds ``runs``, an array of ``start`` (number of the first word), ``length`` and ``period`` in
    words, by start and then period; and ``collapsed``, the words joined by a space without those
    that lie in a run after its first period. Words lie between ASCII white space. A run is a
    stretch with its smallest period, of at least ``least`` words and twice the period, that no
    neighbouring word extends.

    Null and empty texts have no words, no runs and collapse to an empty text. Rows do not
    influence each other, so repeated rows and ids are no special case. Older columns of these
    names are replaced. A text is the work of one task, however long.
    """
    return with_results(docs, [text], others(docs, [f.name for f in RESULT]), RESULT, _find(least))

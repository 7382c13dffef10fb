"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language, in order of frequency. A text's
own list is compared to each: every n-gram counts by how many places it is out of place, one that
the profile lacks counts the length of the profile. The language with the smallest sum wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tideline.llm.batches import others, prepare, quoted, slices, spans, with_results

#: Places of a profile.
PLACES = 300
#: Longest n-grams. Text is words with a space on both sides.
LONGEST = 3
UNKNOWN = "und"
_SPACE = 32
_LETTERS: list[np.ndarray] = []
_PARTS = 64  # parts in which the n-grams of a language are ranked at first


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and count of every distinct n-gram of every text.

    Letters are lower-cased, all else separates words. An n-gram lies within a word or includes
    the space before or after it. Within a text, rows are in the order of length and code points.
    """
    n = len(offsets) - 1
    ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    plain = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n), np.diff(ends) + 1)
    chars = np.zeros(len(plain) + n + 1, np.int64)  # a gap before the first and after each text
    chars[1 + np.arange(len(plain)) + np.repeat(np.arange(n), np.diff(ends))] = letters()[plain]
    inside = chars != 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    chars, doc, inside = chars[keep], np.concatenate([[0], doc])[keep], inside[keep]
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)  # the gap comes first
    small = (np.cumsum(seen) - 1)[chars]
    size, m = len(alphabet), len(chars)
    alphabet[0] = _SPACE
    out_doc, out_code, out_count = [], [], []
    for k in range(1, LONGEST + 1):
        if m < k:
            break
        letter = [inside[j:m - k + 1 + j] for j in range(k)]
        ok = letter[k // 2] if k != 2 else letter[0] | letter[1]
        for middle in letter[1:-1]:
            ok = ok & middle
        at = np.flatnonzero(ok)
        owner = doc[at + k // 2] if k != 2 else doc[at + ~letter[0][at]]
        key = owner
        for j in range(k):
            key = key * size + small[at + j]
        key = np.sort(key)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        rest, code = key[start], np.zeros(len(start), np.int64)
        for j in range(k):
            code |= alphabet[rest % size] << 21 * j
            rest //= size
        out_doc.append(rest)
        out_code.append(code)
        out_count.append(np.diff(np.append(start, len(key))))
    if not out_doc:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(out_doc), np.concatenate(out_code), np.concatenate(out_count)


def ranked(doc: np.ndarray, count: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the most frequent n-grams of each text and their places, ties in the order of rows."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = [int(x.max()).bit_length() for x in (doc, count)] + [len(doc).bit_length()]
    if sum(wide) <= 62:
        packed = (doc << wide[1] | (1 << wide[1]) - 1 - count) << wide[2] | np.arange(len(doc))
        order = np.sort(packed) & (1 << wide[2]) - 1
    else:
        order = np.lexsort((-count, doc))
    d = doc[order]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    place = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
    top = place < places
    return order[top], place[top]


COUNTED = StructType([
    StructField("lang", StringType()), StructField("code", LongType()), StructField("n", LongType())])


def _sums(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(code, return_inverse=True)
    return codes, np.bincount(at, weights=count, minlength=len(codes)).astype(np.int64)


def _count(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows = 0

    def rows_of():
        for lang, parts in held.items():
            code, n = _sums(*(np.concatenate(x) for x in zip(*parts)))
            for at in range(0, len(code), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code[part])), pa.array(code[part]), pa.array(n[part])],
                    names=["lang", "code", "n"])

    for batch in batches:
        for part in slices(batch, 0):
            doc, code, n = grams(*spans(part.column(0)))
            tags = part.column(1).dictionary_encode()
            names, of = tags.dictionary.to_pylist(), tags.indices.to_numpy()[doc]
            for k, lang in enumerate(names):
                mine = of == k
                held.setdefault(lang, []).append(_sums(code[mine], n[mine]))
                rows += len(held[lang][-1][0])
            if rows > 1_500_000:
                held = {lang: [_sums(*(np.concatenate(x) for x in zip(*p)))] for lang, p in held.items()}
                rows = sum(len(p[0][0]) for p in held.values())
                if rows > 750_000:
                    yield from rows_of()
                    held, rows = {}, 0
    yield from rows_of()


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", places: int = PLACES) -> dict[str, list[int]]:
    """The n-gram codes of each language's profile, from the whole texts of all rows of ``docs``.

    Rows without a language or text teach nothing. Equal counts are ordered by length and code
    points. Counts are summed by Spark; the driver gets at most 64 times ``places`` rows a language.
    """
    prepare(docs.sparkSession)
    known = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang")).where(
        "text is not null and lang is not null")
    counted = known.mapInArrow(_count, COUNTED).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("lang", F.pmod(F.hash("code"), F.lit(_PARTS))).orderBy(F.desc("n"), "code")
    best = counted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= places)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "code", "n").toLocalIterator():
        found.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return {k: [c for _, c in sorted(found[k])[:places]] for k in sorted(found)}


RESULT = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", places: int = PLACES) -> DataFrame:
    """``docs`` with the language of every whole text.

    Adds ``lang_pred`` and ``score``: one minus the distance to the nearest profile, as a share of
    the largest distance possible. A text without a letter, or null, or any text if there are no
    profiles, is ``und`` with score 0. Of equally near languages the first in the order of names
    wins. Rows are handled one by one, so repeated rows stay; older columns of these names are
    replaced.
    """
    names = sorted(profiles)

    def make():
        codes = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in names] or [np.empty(0, np.int64)]))
        rank = np.full((len(names), len(codes) + 1), -1, np.int64)
        for k, name in enumerate(names):
            rank[k, np.searchsorted(codes, profiles[name])] = np.arange(len(profiles[name]))

        def work(column: pa.Array) -> list[pa.Array]:
            doc, code, count = grams(*spans(column))
            n = len(column)
            if not len(doc) or not names:
                return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))]
            order, place = ranked(doc, count, places)
            doc, code = doc[order], code[order]
            at = np.searchsorted(codes, code)
            at[codes[np.minimum(at, len(codes) - 1)] != code] = len(codes)
            listed = np.bincount(doc, minlength=n)
            best, which = np.full(n, np.inf), np.zeros(n, np.int64)
            for k in range(len(names)):
                theirs = rank[k][at]
                out = np.where(theirs < 0, places, np.abs(theirs - place))
                far = np.bincount(doc, weights=out, minlength=n)
                nearer = far < best
                best[nearer], which[nearer] = far[nearer], k
            some = listed > 0
            score = np.where(some, 1 - best / np.maximum(1, listed * places), 0.0)
            lang = np.where(some, np.array(names, object)[which], UNKNOWN)
            return [pa.array(lang, pa.string()), pa.array(score)]
        return work

    return with_results(docs, [text], others(docs, ["lang_pred", "score"]), RESULT, make)

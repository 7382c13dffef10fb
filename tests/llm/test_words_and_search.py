"""Spelling variants, top-k search and periodic runs, against SQL or brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import topk, variants
from tideline.llm.queries import QUERIES, with_planted_runs
from tideline.llm.runs import find_runs
from tideline.llm.topk import scaled, search
from tideline.llm.variants import Acceptor, count_words, group_variants, near_pairs

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(around), best if best and counts[best] >= ratio * n else None)
    return out


def roots(told):
    def last(w):
        return w if told[w][2] is None else last(told[w][2])
    return {w: last(w) for w in told}


def vocabulary(seed, size, letters="abcé\U0001f600", longest=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(2, longest))) for _ in range(size)}
    return {w: rng.choice([1, 2, 5, 10, 50, 250]) for w in sorted(words)}


@pytest.mark.parametrize("letters", [100_000, 40, 1])
def test_variants_in_partitions_of_any_size(letters, spark, monkeypatch):
    monkeypatch.setattr(variants, "LETTERS", letters)
    counts = vocabulary(letters, 300)
    counts |= {"x" * 40 + w: n for w, n in vocabulary(7, 60).items()}  # a third share their first letters
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("old")).repartition(3)
    got = {r["word"]: r for r in group_variants(df).collect()}
    want = grouped(counts)
    assert {w: (r["n"], r["n_near"], r["form"]) for w, r in got.items()} == want
    assert {w: r["root"] for w, r in got.items()} == roots(want)
    assert all(r["form_n"] == (counts[r["form"]] if r["form"] else None) for r in got.values())


def test_variants_of_chains_and_of_no_words(spark):
    chain = {"aaaaaa"[:k] + "b" * (6 - k): 5 ** k for k in range(7)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r["root"] for r in group_variants(df).collect()} == {"aaaaaa"}
    assert group_variants(df.where("false")).count() == 0
    long = {"ab" * 20_000: 1, "ab" * 20_000 + "a": 10, "ab" * 19_999 + "ba": 3}
    got = {r["n"]: (r["n_near"], r["form_n"]) for r in group_variants(
        spark.createDataFrame(list(long.items()), "word string, n long")).collect()}
    assert got == {1: (1, 10), 10: (2, None), 3: (1, None)}


def test_acceptors_are_minimal():
    words = sorted({"".join(random.Random(k).choice("ab") for k in range(s, s + 6)) for s in range(60)})
    acceptor = Acceptor(words)
    rights = {}

    def right(state):
        arcs = acceptor.arcs[state]
        return frozenset(c + r for c, to in arcs.items() for r in right(to)) if arcs else frozenset([""])

    for state in range(len(acceptor.arcs)):
        assert rights.setdefault(right(state), state) == state
    assert sorted(right(acceptor.start)) == words
    assert acceptor.words[acceptor.start] == len(words)


def test_compositions_accept_just_the_near_pairs():
    rng = random.Random(3)
    for _ in range(200):
        m = rng.randint(1, 5)
        short = list({"".join(rng.choice("abc") for _ in range(m)) for _ in range(rng.randint(1, 30))})
        long = list({"".join(rng.choice("abc") for _ in range(m + 1)) for _ in range(rng.randint(0, 30))})
        got = sorted(tuple(sorted(p, key=lambda w: (len(w), w))) for p in near_pairs(short, long))
        assert got == sorted([(a, b) for a in short for b in short if a < b and near(a, b)]
                             + [(a, b) for a in short for b in long if near(a, b)])


def test_counted_words(spark):
    rows = [(1, "Straße STRASSE straßen"), (2, None), (3, ""), (None, "straße, straßen; ÉTOILE étoile x×y÷z"), (1, "Straße STRASSE straßen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("old"))
    got = {r["word"]: r["n"] for r in count_words(df).collect()}
    assert got == {"straße": 3, "strasse": 2, "straßen": 3, "Étoile": 1, "étoile": 1}
    assert got != {} and count_words(df.where("false")).count() == 0
    missing = Counter()
    for k, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            h = crc32(f"{'' if k is None else k}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 2 == 0 else w
            missing[w] += len(w) >= 6
    assert {r["word"]: r["n"] for r in count_words(df, doc_id="doc_id", misprint=2).collect()} == dict(+missing)


def searched(rows, k, asks):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    out = []
    for q, (i, v) in enumerate(usable):
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(usable)
                           if c != q and len(w) == len(v))[:k]
            out.extend((i, rank, j, -s) for rank, (s, j) in enumerate(found, 1))
    return sorted(out)


@pytest.mark.parametrize("shard,block,pass_bytes,fan", [(4096, 512, 1 << 20, 16), (64, 3, 200, 2)])
def test_search(shard, block, pass_bytes, fan, spark, monkeypatch):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("PASS_BYTES", pass_bytes), ("FAN", fan)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(shard)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 4, 4)]) for i in rng.permutation(300)]
    rows += [(k, [1, 1, 0, 0]) for k in range(300, 400)] + rows[:5]  # a third are equal, some rows repeat
    rows += [(1000, [1 << 40, 5, 0, 1]), (1005, [-(1 << 20), 1 << 13, 1, 1]), (-20, [1, 2]), (40, [2, 1]), (2000, [])]
    rows += [(60, None), (61, [1, None, 2, 3]), (None, [1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit("old")).repartition(5)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(df, F.col("vec_id") % 5 == 0, 7).collect()]
    assert sorted(got) == searched(rows, 7, lambda i: i % 5 == 0)


def test_search_without_rows_or_queries(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, vector array<long>")
    assert search(df.where("false"), F.lit(True)).count() == 0
    assert search(df, F.lit(False)).count() == search(df, F.lit(None)).count() == 0
    assert [tuple(r) for r in search(df, F.lit(True)).orderBy("query_id").collect()] == [(1, 1, 2, 11), (2, 1, 1, 11)]


def test_scaled_components(spark):
    rows = [([0.5, -0.001, 1e300],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)]
    df = spark.createDataFrame(rows, "embedding array<double>").select(scaled("embedding").alias("v"))
    assert [r["v"] for r in df.collect()] == [[32, -1, 1 << 62], None, None, None, None, []]


def runs(words, least=12):
    found = set()
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i:
                size = j - i + p
                if size >= max(least, 2 * p) and not any((i, size, q) in found for q in range(1, p)):
                    found.add((i, size, p))
            i = max(j, i + 1)
    return sorted(found)


def planted(doc_id, words):
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_brute_force_takes_the_smallest_period():
    assert runs("abab" * 4, 4) == [(0, 16, 2)] and runs("aaaa", 4) == [(0, 4, 1)]


def test_runs_of_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {d["doc_id"] for d in docs}

    def sha(x):
        return hashlib.sha256(x).hexdigest()

    for d in docs:
        words = planted(d["doc_id"], re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").encode()))
        want = runs(words) if len(words) < 3000 else None
        r = got[d["doc_id"]]
        if want is None:
            continue
        gone = {i for s, size, p in want for i in range(s + p, s + size)}
        top = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if want else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{size},{p}\n" for s, size, p in want).encode())
        assert r["collapsed_sha256"] == sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_of_odd_texts(least, spark):
    rng = random.Random(least)
    texts = [None, "", " \t\n", "a", "a " * 40, "a b " * 30 + "a", "x" + " a b a b a" * 9, "é é " * 20, "b " * 12 + "a " * 12]
    for _ in range(300):
        words = [rng.choice("ab" + "cde" * rng.randint(0, 1)) for _ in range(rng.randint(0, 90))]
        p, a = rng.randint(1, 20), rng.randint(0, max(0, len(words) - 1))
        texts.append(" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))) if a + p < len(words)
                     else "\r\n".join(words))
    df = spark.createDataFrame([(k % 200, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns(
        {"runs": F.lit("old"), "r0": F.lit("old")}).repartition(3)
    for r in find_runs(df, least=least).collect():
        words = re.findall("[^\x20\x09-\x0D]+", r["text"] or "")
        want = runs(words, least)
        gone = {i for s, size, p in want for i in range(s + p, s + size)}
        assert [tuple(x) for x in r["runs"]] == want and r["r0"] == "old"
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert find_runs(df.where("false")).count() == 0


def test_planted_runs(spark):
    rows = [(k, " one  two\tthree four five six seven eight nine " * (k % 4)) for k in range(80)] + [(None, "a b c"), (10, None)]
    for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = next(t for k, t in rows if k == r["doc_id"]) or ""
        assert (r["text"] or "").split() == planted(r["doc_id"], words.split()) or r["doc_id"] == 10

"""Skewed benchmarks against plain search, likelihoods and the classifier against counting n-gram by n-gram."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm.decontaminate import _passes, mark_benchmark
from tideline.llm.pseudo import FIRST, HASHED, PLACES, SIZE, TOKENS, Network, Tokens, learn_model, score_texts
from tideline.llm.queries import QUERIES
from tideline.llm.toxicity import ERRORS, HASH_BITS, LENGTHS, PRIOR, learn_toxicity, log_ratios, score_toxicity
from tideline.session import Scratch


def test_passes_of_a_skewed_benchmark(spark):
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(300)]

    def passage(n):
        return " ".join(rng.choice(names, n))

    texts = [passage(int(n)) for n in rng.integers(3, 40, 300)]
    items = [(f"i{k:04d}", t) for k, t in enumerate(texts)] + [(f"same{k:04d}", texts[0]) for k in range(150)]
    items += [("i0001", texts[1]), (None, texts[2]), ("none", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(k, " ".join([passage(20), texts[k % 300] if k % 3 else passage(5), passage(9)])) for k in range(120)]
    docs.append((120, passage(4) + " " + texts[0].upper() + " " + texts[2]))
    limit = 3000
    with Scratch(spark) as scratch:
        parts = [p.collect() for p in _passes(bench.selectExpr("item_id as item", "text").where("text is not null"), limit, scratch)]
    sizes = [sum(len(r["text"]) + sum(map(len, r["ids"])) for r in p) for p in parts]
    assert len(parts) > 3 and max(sizes) <= limit
    assert sorted((i, r["text"]) for p in parts for r in p for i in r["ids"]) == sorted({i for i in items if None not in i})
    owners = {}
    for item, text in items:
        words = re.findall(r"\w+", text or "")
        for k in range(max(1, len(words) - 9) if words else 0):
            owners.setdefault(tuple(words[k:k + 10]), set()).add(item)
    out = mark_benchmark(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench, pass_bytes=limit)
    got = {r["doc_id"]: r for r in out.collect()}
    lengths = {len(w) for w in owners}
    for k, text in docs:
        words, hit, ids = text.lower().split(), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = owners.get(tuple(words[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        assert {i for h in got[k]["hits"] for i in range(h["first"], h["last"] + 1)} == hit
        assert got[k]["items"] == sorted(ids - {None})


def grams(text):
    """Hashes of the n-grams of bytes of a text, each once."""
    raw = b" " + re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()) + b" "
    return {
        (((int.from_bytes(raw[i:i + k], "little") + k) * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 64 - HASH_BITS
        for k in LENGTHS for i in range(len(raw) - k + 1)}


def test_classifier_by_counting(spark):
    rng = np.random.default_rng(4)
    words = ["plain", "river", "stone", "Cloud", "green", "über", "vile", "nasty"]
    docs = [(k, " ".join(rng.choice(words[:6], 8)) + (" " + " ".join(rng.choice(words[6:], 2)) if k % 4 == 0 else ""))
            for k in range(400)] + [(400, None), (401, ""), (402, "ab")]
    labels = [(k, int(k % 4 == 0)) for k, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = np.bincount([c for _, c in labels])
    counts = [Counter(), Counter()]
    for (_, text), (_, c) in zip(docs, labels):
        counts[c].update(grams(text))
    smooth = [{f: counts[c][f] + PRIOR * texts[c] / texts.sum() for f in counts[0] | counts[1]} for c in (0, 1)]
    ratio = {f: np.log(smooth[1][f] / texts[1]) - np.log(smooth[0][f] / texts[0]) for f in smooth[0]}
    error = {f: (1 / smooth[1][f] + 1 / smooth[0][f]) ** 0.5 for f in ratio}
    got, spread, n = log_ratios(df.join(marks, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").alias("label")))
    assert (n == texts).all() and all(abs(got[f] - r) < 1e-9 and abs(spread[f] - error[f]) < 1e-9 for f, r in ratio.items())
    model = learn_toxicity(df, marks, F.lit(True))
    # every feature beyond the bound is weighed, however many there are
    assert set(model.features.tolist()) == {f for f, r in ratio.items() if abs(r) >= ERRORS * error[f]}
    weight = dict(zip(model.features.tolist(), model.weights))
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    for k, text in docs:
        z = model.intercept + sum(weight.get(f, 0) for f in grams(text))
        assert abs(scored[k] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert min(scored[k] for k in range(0, 400, 4)) > max(scored[k] for k in range(400) if k % 4)


def test_toxicity_of_held_out_texts(spark):
    """Only labels that taught nothing: the order of their scores, and what is above the bound."""
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op9_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert all(crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    bad = np.array([r["score"] for r in held if toxic[r["doc_id"]] == 1])
    good = np.array([r["score"] for r in held if toxic[r["doc_id"]] == 0])
    assert len(bad) and (bad[:, None] > good).mean() >= 0.85 and np.mean(good >= 0.3) <= 0.05


def test_words_joined_or_known_score_alike_and_as_counted_by_hand(spark):
    common = [f"c{k}" for k in range(FIRST - 1)]
    rare = [f"r{k}" for k in range(3000)]
    texts = [" ".join(common * 9)] + [f"c1 {w} c2 {w} " * (1 + k % 3) for k, w in enumerate(rare)]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2).persist()
    few, all_of_them = learn_model(corpus, known=FIRST - 1), learn_model(corpus)
    assert len(few.words) == FIRST - 1 and len(all_of_them.words) == FIRST - 1 + len(rare) and few.rare.counts.count() == len(rare)
    few.values = all_of_them.values
    asked = spark.createDataFrame([(w, f"c1 {w} c7") for w in [*rare, "never", "c3"]], "asked string, text string")
    joined, known = ({r["asked"]: r for r in score_texts(asked, m, keep=["asked"]).collect()} for m in (few, all_of_them))

    counts = Counter(w for t in texts for w in t.split())
    by, pairs = defaultdict(list), Counter()
    for w in counts:
        pairs.update(zip(f"\n{w}", f"{w}\n"))
    for w in rare:
        by[crc32(w.encode()) % HASHED].append(w)
    starts = Counter()
    for (a, _), n in pairs.items():
        starts[a] += n
    for w in [*rare[::50], "never"]:
        kinds = by[crc32(w.encode()) % HASHED]
        spelled = math.prod((pairs[p] + 1) / (starts[p[0]] + 256) for p in zip(f"\n{w}", f"{w}\n"))
        share = (counts[w] + max(1, len(kinds)) * spelled) / (sum(counts[k] for k in kinds) + max(1, len(kinds)))
        for got in (joined, known):
            assert got[w]["word_log_likelihood"] - got[w]["log_likelihood"] == pytest.approx(math.log(share), abs=1e-4)
    assert all(joined[w]["word_log_likelihood"] == pytest.approx(known[w]["word_log_likelihood"], abs=1e-5) for w in known)
    assert known["c3"]["word_log_likelihood"] == known["c3"]["log_likelihood"]


def test_the_network_learns_more_than_frequencies_and_is_a_distribution(spark):
    """Of sf0.01, on texts that it was not trained on; and against a network written out for one position."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = learn_model(docs.where(~held))
    tokens, net = Tokens(model.words), Network(model.values)
    texts = [r["text"].lower().encode().split() for r in docs.where(held).select("text").collect()]
    _, ids, at, _, _ = tokens.of(texts)
    trained = [r["text"].lower().encode().split() for r in docs.where(~held).select("text").collect()]
    _, old, where, _, _ = tokens.of(trained)
    share = np.bincount(old[where], minlength=TOKENS) + 1.0
    frequency = np.log(share / share.sum())[ids[at]]
    got = net.log_probability(ids, at)
    assert got.mean() > frequency.mean() + 0.02
    embed, cw, cb, tw, tb = (x.astype(float) for x in net.parts)
    for k in range(0, len(at), len(at) // 20):
        h = np.tanh(sum(embed[j][ids[at[k] + place]] for j, place in enumerate(PLACES)))
        token = int(ids[at[k]])
        kind = (1 + (h @ cw + cb) / 1024) ** 1024
        inside = (1 + (h @ tw[token // SIZE] + tb[token // SIZE]) / 1024) ** 1024
        want = np.log(kind[token // SIZE] / kind.sum()) + np.log(inside[token % SIZE] / inside.sum())
        assert got[k] == pytest.approx(want, abs=2e-2)


def test_features_are_those_of_every_text_alone():
    """Hashed a bounded stretch at a time; short, empty and missing texts, zeros inside, repeated n-grams."""
    from tideline.llm import toxicity as tox

    texts = ["", "a", "abc", None, "ab\0cdefg hi", "\0", "Bad WORD bad word " * 9, "\u00e9" * 40, *[f"text {k} of many" for k in range(300)],
             "".join(chr(97 + k * k % 23) for k in range(3 * tox._RUN))]

    def alone(text):
        data = b" " + (text or "").encode().translate(tox._FOLD) + b" "
        grams = {(k, data[i:i + k]) for k in tox.LENGTHS for i in range(len(data) - k + 1)}
        return {((int.from_bytes(g, "little") + k) * int(tox._K) % 2**64) >> (64 - tox.HASH_BITS) for k, g in grams if 0 not in g}

    offsets, raw = tox.spans(pa.array(texts))
    runs = list(tox._runs(offsets, raw))
    assert len(runs) > 5 and all(len(b) - 1 <= tox._TEXTS and (len(b) == 2 or b[-1] <= 2 * tox._RUN) for _, b, _ in runs)
    want = [sorted(alone(t)) for t in texts]
    for wanted in (np.ones(1 << tox.HASH_BITS, bool), np.arange(1 << tox.HASH_BITS) % 7 == 3):
        doc, f = tox.features(offsets, raw, wanted)
        assert [f[doc == k].tolist() for k in range(len(texts))] == [[x for x in w if wanted[x]] for w in want]

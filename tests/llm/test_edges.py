"""Every operator and stage: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm.batches import BLOCKS, sum_blocks
from tideline.llm.bpe import decode_ids, encode_and_decode, encode_texts
from tideline.llm.chat import format_conversations, read_conversations
from tideline.llm.decontaminate import mark_benchmark
from tideline.llm.language import identify, learn_profiles
from tideline.llm.licenses import SENTENCES, match, scan_licenses, sentences
from tideline.llm.pseudo import (
    CLASSES, FIRST, HASHED, LARGEST, PLACES, RATE, SIZE, TOKENS, Network, Tokens, _count, _train, learn_model, score_texts,
)
from tideline.llm.queries import tokenizer_file
from tideline.llm.repeats import remove_repeats
from tideline.llm.simhash import group_near_copies
from tideline.llm.toxicity import learn_toxicity, score_toxicity
from tideline.llm.vectors import group_near_vectors

LONG = "the cat sat on the mat and ate it. " * 9000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the cat and the dog went to the river to drink", "en", "a", 46),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "12345 ... !!!", "en", None, 13),
    (None, "le chat et le chien vont boire au bord de l'eau", "fr", "b", 47),
    (5, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (1, "the cat and the dog went to the river to drink", "en", "a", 46),
    (6, "\0<|endoftext|>é\U0001f600", None, "a", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (5, 0), (5, None), (None, 1), (9, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([
        (7, "The cat, and the DOG"), (8, None), (None, "le chat et"), (7, "the cat and the dog"), (9, "...")],
        "item_id long, text string")


def operators(spark, bench, labels):
    return {
        "licences": (scan_licenses, ["sentences", "licenses"]),
        "benchmark": (lambda d: mark_benchmark(d, bench), ["n_words", "hits", "items"]),
        "passes": (lambda d: mark_benchmark(d, bench, pass_bytes=10), ["n_words", "hits", "items"]),
        "simhash": (group_near_copies, ["fingerprint", "component_id"]),
        "likelihood": (lambda d: score_texts(d, learn_model(d)), ["n_tokens", "log_likelihood"]),
        "language": (lambda d: identify(d, learn_profiles(d)), ["lang_pred", "score"]),
        "encode": (lambda d: encode_texts(d, tokenizer_file()), ["ids"]),
        "round_trip": (lambda d: encode_and_decode(d, tokenizer_file()), ["ids", "decoded"]),
        "toxicity": (lambda d: score_toxicity(d, learn_toxicity(d, labels, F.lit(True))), ["score"]),
        "repeats": (lambda d: remove_repeats(d, length=40), ["spans", "kept"]),
    }


NAMES = ["licences", "benchmark", "passes", "simhash", "likelihood", "language", "encode", "round_trip", "toxicity", "repeats"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay_and_clashing_columns_give_way(name, spark, docs, bench, labels):
    run, made = operators(spark, bench, labels)[name]
    clash = {c: F.lit("old") for c in (*made, "row", "fp", "h1", "id", "key", "i0", "k0", "r0", "runs", "vector", "N_WORDS")}
    if "n_words" in made:
        del clash["n_words"]
    out = run(docs.withColumns(clash))
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert not any(r[c] == "old" for r in rows for c in made)
    assert all(r["row"] == "old" and r["h1"] == "old" and r["i0"] == "old" for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(name, spark, docs, bench, labels):
    run, made = operators(spark, bench, labels)[name]
    out = run(docs.where("false"))
    assert out.count() == 0 and set(made) <= set(out.columns)


def test_values_of_the_odd_rows(spark, docs, bench, labels):
    ops = operators(spark, bench, labels)

    def by_text(name, *columns):
        return {r["text"]: tuple(r[c] for c in columns) for r in ops[name][0](docs).collect()}

    told = by_text("language", "lang_pred", "score")
    assert told[None] == told[""] == told["12345 ... !!!"] == ("und", 0.0) and told[LONG][0] == "en"
    for name in ("benchmark", "passes"):
        marked = by_text(name, "n_words", "hits", "items")
        assert marked[None] == marked[""] == (0, [], [])
        assert marked[ROWS[0][1]][2] == ["7"] and [tuple(h) for h in marked[ROWS[0][1]][1]] == [(0, 4)]
        assert marked[ROWS[4][1]][2] == [] and [tuple(h) for h in marked[ROWS[4][1]][1]] == [(0, 2)]
    linked = by_text("simhash", "fingerprint", "component_id")
    assert linked[None] == linked[""] == ("0" * 16, 2) and linked[ROWS[4][1]][1] is None and linked[LONG][1] == 5
    cut = by_text("repeats", "spans", "kept")
    assert cut[None] == ([], b"") and cut[LONG][1] == b"" and [tuple(s) for s in cut[LONG][0]] == [(0, len(LONG))]
    back = by_text("round_trip", "ids", "decoded")
    assert back[None] == back[""] == ([], "") and all(d == (t or "") for t, (_, d) in back.items())
    assert 50256 in back[ROWS[8][1]][0]
    score = by_text("likelihood", "n_tokens", "log_likelihood")
    assert score[None] == score[""] == (0, 0.0) and score[LONG][0] == 9 * 9000 and score[LONG][1] < 0
    assert all(0 <= s <= 1 for (s,) in by_text("toxicity", "score").values())


def test_decode_is_the_inverse_of_encode(spark, docs):
    ids = encode_texts(docs, tokenizer_file())
    assert decode_ids(ids, tokenizer_file()).where("decoded <> coalesce(text, '')").count() == 0


def test_one_class_or_no_labels(spark, docs, labels):
    for some in (labels.where("toxic = 1"), labels.where("false")):
        scores = {r["score"] for r in score_toxicity(docs, learn_toxicity(docs, some, F.lit(True))).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "<|im_end|>x"), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "<|im_end|>x"),
        (None, 0, "a\nb", "<\\|"), (2, 0, "user", ""), (3, 0, "assistant", LONG * 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    read = {r["conv_id"]: r for r in read_conversations(format_conversations(table)).collect()}
    assert {k: r["n_turns"] for k, r in read.items()} == {1: 4, None: 1, 2: 1, 3: 1}
    assert read[1]["loss_chars"] == 22 and read[3]["loss_chars"] == 3 * len(LONG) and read[2]["loss_chars"] == 0
    assert read_conversations(format_conversations(table.where("false"))).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (1, None), (4, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (None, [0.0, -1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit(1)).withColumn("h1", F.lit(1))
    out = group_near_vectors(df).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert by[5] == by[3] == (2, 2, False) and by[2] == (2, 2, True) and by[9] == (1, 9, True) and by[11] == (0, 11, True)
    assert all(by[k] == (0, k, True) for k in (1, 4, 6, 7, 8, 10)) and by[None] == (0, None, False) and len(out) == len(rows)
    assert group_near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    source = docs.withColumns({c: F.lit("old") for c in ("ids", "score", "hits", "component_id", "kept")})
    out = stage(spark, source, str(tmp_path))
    assert stage(spark, source.where("false"), str(tmp_path)).count() == 0
    if k + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == list(corpus_pipeline.COLUMNS)
    want = {"language": 6, "near_copies": 6, "repeats": 9, "benchmark": 6, "tokens": 9}[name]
    assert out.count() == want


def test_rare_words_are_told_apart(spark):
    """Of words with one token and the same neighbours: the frequent one, the rare one, one never seen."""
    bucket = lambda w: crc32(w.encode()) % HASHED
    common = [f"c{k}" for k in range(FIRST - 1)]
    by = defaultdict(list)
    for k in range(6 * HASHED):
        by[bucket(f"r{k}")].append(f"r{k}")
    often, seldom, never = next(ws for ws in by.values() if len(ws) > 2)[:3]
    texts = [" ".join(common * 9), f"c1 {often} c2 " * 6, f"c1 {seldom} c2"]
    model = learn_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [(w, f"c1 {w} c2") for w in (often, seldom, never)]
    got = {r["word"]: r["word_log_likelihood"] for r in score_texts(
        spark.createDataFrame(asked, "word string, text string"), model).collect()}
    assert got[often] > got[seldom] + 1 > got[never] + 2


def test_every_word_is_predicted_in_training(spark):
    texts = spark.createDataFrame([(f"a b c d e {k} g h",) for k in range(50)] + [("",), (None,)], "text string")
    values = Network.fresh(np.ones(TOKENS)).values
    total = sum_blocks(texts.mapInArrow(_train([b"a", b"b", b"c"], values), BLOCKS), Network.LENGTH + 1)
    assert total[-1] == 50 * 8


def test_words_are_counted_once_a_batch():
    odd = [None, "", " \t", " A b\x0bA\x0c", "\x1cx\x1f \x85\xa0 É é\0 a", "ZZ\r\nzz\n"]
    texts = pa.array(["cut off", *odd, *["a b"] * 1000], pa.string()).slice(1)
    want = [(t or "").encode().lower().split() for t in texts.to_pylist()]
    assert Tokens.split(texts).to_pylist() == want
    out = list(_count(iter([pa.RecordBatch.from_arrays([texts], names=["text"])] * 2)))
    rows = [(r["word"], r["n"]) for batch in out for r in batch.to_pylist()]
    counts = Counter(w for ws in want for w in ws)
    assert sorted(rows) == sorted([*counts.items()] * 2)
    tokens = Tokens([b"a", b"b"])
    assert all(np.array_equal(x, y) for x, y in zip(tokens.of(Tokens.split(texts)), tokens.of(want)))
    assert tokens.of(want)[4] == list(dict.fromkeys(w for ws in want for w in ws if w not in (b"a", b"b")))


def test_a_step_of_training_is_that_of_the_formulas():
    rng = np.random.default_rng(5)
    ids = np.zeros(304, np.int64)
    ids[2:302] = rng.integers(1, 12, 300) * 301 % TOKENS
    at, net = np.arange(2, 302), Network.fresh(rng.integers(1, 90, TOKENS).astype(float))
    net.values[:] += rng.normal(0, 0.05, Network.LENGTH)
    parts = embed, cw, cb, tw, tb = [x.astype(float) for x in net.parts]
    seen = Network._cut(np.full(Network.LENGTH, 1e-3, np.float32))
    grads = [np.zeros(x.shape) for x in parts]
    for i in at:
        h = np.tanh(sum(embed[j][ids[i + place]] for j, place in enumerate(PLACES)))
        c, t = divmod(int(ids[i]), SIZE)
        p, q = (1 + (h @ cw + cb) / 1024) ** 1024, (1 + (h @ tw[c] + tb[c]) / 1024) ** 1024
        p, q = p / p.sum() - (np.arange(CLASSES) == c), q / q.sum() - (np.arange(SIZE) == t)
        back = (cw @ p + tw[c] @ q) * (1 - h * h)
        for j, place in enumerate(PLACES):
            grads[0][j][ids[i + place]] += back / len(at)
        for g, more in ((grads[1], np.outer(h, p)), (grads[2], p), (grads[3][c], np.outer(h, q)), (grads[4][c], q)):
            g += more / len(at)
    net.train(ids, at, seen)
    for k, (part, g) in enumerate(zip(parts, grads)):
        want = part - RATE * g / (np.sqrt(1e-3 + g * g) + 1e-6)
        np.testing.assert_allclose(net.parts[k], np.clip(want, -LARGEST, LARGEST) if k in (1, 3) else want, atol=2e-5)
        np.testing.assert_allclose(seen[k], 1e-3 + g * g, atol=1e-6)


SHORTEST = {
    "GPL": ["Released under the GPL v3."], "LGPL": ["Distributed under the terms of the LGPL."],
    "AGPL": ["Available under the AGPL"], "Apache": ["Licensed under the Apache License"],
    "MIT": ["Released under the MIT license"], "BSD": ["Released under the BSD license"],
    "MPL": ["Subject to the Mozilla Public License"],
    "CC": ["Available under CC BY 4.0.", "Available under Creative Commons BY-SA 4.0", "Released under CC-0"],
    "Grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
              "associated documentation files to"],
    "MITCondition": ["The above copyright notice and this permission notice shall be included in all copies or "
                     "substantial portions of the software"],
    "AsIs": ["The software is provided as is here"],
    "BSDGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met"],
    "BSDSource": ["Redistributions of source code must retain the above copyright notice and"],
    "BSDBinary": ["Redistributions in binary form must reproduce the above copyright notice and"],
    "BSDName": ["Neither the name X may be used to endorse or promote products here"],
    "SPDX": ["SPDX-License-Identifier: MIT"], "Copyright": ["(c) 2020", "C 2020 X", "© 2020", "Copyright 2020"],
    "Not": ["Not released under MIT", "never shared by the GPL"], "EPL": ["Governed by the EPL", "Eclipse Public License"],
    "BSL": ["Offered under BSL 1.0", "Boost Software License"], "ISC": ["Shared under ISC", "ISC license"],
    "Zlib": ["Published under zlib", "zlib license"], "Artistic": ["Covered by the Artistic License 2.0", "Artistic License"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain"],
    "WTFPL": ["Provided under WTFPL", "Do what the fuck you want to public license"],
    "ISCGrant": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "ZeroGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
                  "to alter it and redistribute it freely, subject to the following restrictions"],
    "BoostGrant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                   "and accompanying documentation covered by this license to"],
    "AllRights": ["All rights reserved"], "PublicDomain": ["Placed in the public-domain", "Dedicated to the public  domain"],
}


def test_shortest_licence_sentences_pass_the_cues():
    assert set(SHORTEST) == {name for name, _ in SENTENCES}
    for name, texts in SHORTEST.items():
        for text in texts:
            assert [s.name for s in sentences(text)] == [name], text


BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer.
3. Neither the name of X nor the names of its contributors
   may be used to endorse or promote products
   derived from this software.

THIS SOFTWARE IS PROVIDED BY X
"AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND.
"""
NOTICE = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_licences(mark):
    def found(text):
        return match(sentences("\n".join(mark + line for line in text.split("\n"))))

    assert found(MIT) == ["MIT"] and found(BSD3) == ["BSD-3-Clause"]
    assert found("Licensed under the Apache License,\nVersion 2.0 (the \"License\");") == ["Apache-2.0"]
    for kind, name, version in (("", "GPL", "2"), ("Lesser ", "LGPL", "2.1"), ("Affero ", "AGPL", "3")):
        assert found(NOTICE.format(";", kind, version)) == [f"{name}-{version}-or-any-later-version"]
    assert found(NOTICE.format(":", "", "3").replace("; either", ", either")) == ["GPL-3-or-any-later-version"]
    lines = "Some words\nReleased under the MIT License\nCopyright 2020 X\nAll rights reserved"
    assert found(lines) == ["MIT", "Proprietary"]

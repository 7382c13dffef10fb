"""The registered queries on the given tables, against SQL, a library, or brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from compare import connect, differences
from tideline.llm.licenses import match, sentences
from tideline.llm.pseudo import Network, TOKENS
from tideline.llm.queries import ORACLE, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(name, spark):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_licenses(spark, docs):
    got = rows(spark, "op1_licenses")
    assert set(got) == set(docs)
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
        "GPL-3": "licensed under the GNU General Public License, version 3.", "CC-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
        "Proprietary": "All rights reserved."}
    for k, r in got.items():
        assert r["licenses"] == ",".join(sorted(n for n, line in lines.items() if line in docs[k]["text"]))
    assert any(r["licenses"] for r in got.values())


#: Statements as they stand in files, with the licences that a reader takes from them.
STATEMENTS = [
    ("MIT License", ["MIT"]), ("The MIT License (MIT)", ["MIT"]), ("License: MIT", ["MIT"]), ("Licence: ISC", ["ISC"]),
    ("Licensed under MIT license.", ["MIT"]), ("Released under MIT.", ["MIT"]),
    ("GNU GENERAL PUBLIC LICENSE Version 3", ["GPL-3"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3"]),
    ("licensed under the GPLv3", ["GPL-3"]), ("Licensed under GPL-3.0", ["GPL-3.0"]), ("Licensed under GPLv2+", ["GPL-2-or-later"]),
    ("distributed under the GNU GPL v2 license", ["GPL-2"]), ("Released under the GPL v3.", ["GPL-3"]),
    ("Licensed under the terms of version 2 of the GNU General Public License", ["GPL-2"]),
    ("Distributed under the terms of the LGPL.", ["LGPL"]), ("BSD 3-Clause License", ["BSD-3"]), ("The 2-Clause BSD License", ["BSD-2"]),
    ("Licensed under Apache 2.0", ["Apache-2.0"]), ("Apache License\nVersion 2.0, January 2004", ["Apache-2.0"]),
    ("# Licensed under the Apache License,\n# Version 2.0 (the \"License\")", ["Apache-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
     "provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this "
     "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:", ["Zlib"]),
    ("Eclipse Public License - v 2.0", ["EPL-2.0"]),
    ("made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution", ["EPL-1.0"]),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-by-sa-4.0"]),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-by-nc-nd-4.0"]),
    ("Available under CC BY 4.0.", ["CC-by-4.0"]), ("CC0 1.0 Universal", ["CC-0-1.0"]), ("Available under CC0.", ["CC-0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at x.", ["MPL-2.0"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["SPDX-apache-2.0", "SPDX-mit"]),
    ("not licensed under the MIT License", []), ("This is not\n# licensed under the\n# MIT License", []),
    ("published by a house in Leipzig", []), ("Prices are subject to change.", []), ("They came mit dem Zug.", []),
]


@pytest.mark.parametrize("text, expected", STATEMENTS)
def test_license_statements(text, expected):
    assert match(sentences(text)) == expected


def test_license_rules():
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal.\nThe above copyright notice and this permission notice shall be "
           "included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT.")
    assert match(sentences(mit)) == ["MIT"]
    assert match(sentences(mit.split("\n")[2])) == ["unknown"]  # no rule begins with it
    assert match(sentences("SPDX-License-Identifier: GPL-2.0-or-later")) == ["SPDX-gpl-2.0-or-later"]
    assert match(sentences("Copyright (c) 2020 X. All rights reserved.")) == ["Proprietary"]
    assert match(sentences("Copyright 2020 X")) == [] and sentences(None) == sentences("") == []
    assert match(sentences("Released under the MIT License.\nReleased under the MIT License.")) == ["MIT"]


def unite(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_simhash(spark, docs):
    got, ids = rows(spark, "op3_simhash"), sorted(docs)
    prints = []
    for k in ids:
        words = re.findall(rb"[^\x20\x09-\x0D]+", docs[k]["text"].encode().lower())
        runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = unite(len(ids), pairs)
    assert {k: (got[k]["fingerprint"], got[k]["component_id"]) for k in ids} == {
        k: (f"{prints[i]:016x}", ids[root[i]]) for i, k in enumerate(ids)}


def test_vectors(spark):
    got = {r["vec_id"]: r for r in QUERIES["op5_vectors"](spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in given])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    root = unite(len(x), zip(*np.nonzero(np.triu(near, 1))))
    for k, r in enumerate(given):
        g = got[r["vec_id"]]
        assert (g["n_links"], g["component_id"]) == (near[k].sum() - 1, given[root[k]]["vec_id"])


def test_links_of_made_vectors(spark):
    """The given vectors hold no link; these hold pairs at all cosines above and below the threshold."""
    from tideline.llm.vectors import group_near_vectors

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((600, 64))
    x = np.concatenate([centres, *(centres + rng.uniform(0.05, 0.6, (600, 1)) * rng.standard_normal((600, 64)) for _ in range(4))])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in group_near_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    found = np.array([got[k][0] for k in range(len(x))])
    assert links.sum() > 2000 and (found <= links).all() and found.sum() >= 0.99 * links.sum()
    root = unite(len(x), zip(*np.nonzero(np.triu(near, 1))))
    assert sum(got[k][1] == root[k] for k in range(len(x))) >= 0.99 * len(x)


def test_language(spark, docs):
    got = rows(spark, "op6_language")
    held = [k for k in docs if crc32(str(k).encode()) % 3 == 1]
    assert set(got) == set(docs) and {k for k, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[k]["lang_pred"] == docs[k]["lang"] for k in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    library.no_truncation()
    library.no_padding()
    got = rows(spark, "op8_bpe")
    for k, d in docs.items():
        ids = library.encode(d["text"], add_special_tokens=False).ids
        r = got[k]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_toxicity(spark, docs, labels):
    got = rows(spark, "op9_toxicity")
    assert set(got) == set(docs)
    assert all(r["held_out"] == (crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    # on so few labels only the order of the learned ones is sure
    known = [k for k in labels if not got[k]["held_out"]]
    toxic = [got[k]["score"] for k in known if labels[k] == 1]
    clean = [got[k]["score"] for k in known if labels[k] == 0]
    assert min(toxic) > np.median(clean)


def test_likelihood(spark, docs):
    got = rows(spark, "op4_likelihood")
    words = {k: d["text"].lower().split() for k, d in docs.items()}
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(d["text"].encode().lower().split()) for k, d in docs.items()}
    counts = Counter(w for ws in words.values() for w in ws)
    total = sum(counts.values())
    # better than a guess among the tokens, though barely trained here
    assert sum(r["log_likelihood"] for r in got.values()) / total > -np.log(TOKENS)
    net = Network.fresh(np.ones(TOKENS))
    ids = np.array([0, 0, 5, 6, 7, 0, 0])
    each = [np.exp(net.log_probability(np.array([0, 0, 5, t, 7, 0, 0]), np.array([3])))[0] for t in range(0, TOKENS)]
    assert abs(sum(each) - 1) < 1e-3 and net.log_probability(ids, np.array([2, 3, 4])).shape == (3,)


def removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone, last = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                at = max(i, last)
                gone[at:i + length] = b"\1" * (i + length - at)
                last = i + length
        yield gone


def without_passages(texts, length):
    """Kept bytes and number of removed runs, by words."""
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    words = [[t[a:b] for a, b in ps] for t, ps in zip(texts, places)]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    for t, ps, w in zip(texts, places, words):
        lost = {j for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for j in range(i, i + length)}
        gone = bytearray(len(t))
        for j in lost:
            a, b = ps[j][0], ps[j + 1][0] if j + 1 in lost else ps[j][1]
            gone[a:b] = b"\1" * (b - a)
        yield bytes(b for b, g in zip(t, gone) if not g), len(re.findall(rb"\x01+", bytes(gone)))


def test_repeats(spark, docs):
    got = rows(spark, "op10_repeats")
    texts = {k: d["text"].encode() for k, d in docs.items()}
    for (k, t), (kept, n) in zip(texts.items(), without_passages(list(texts.values()), 50)):
        assert (got[k]["n_passages"], got[k]["n_passage_bytes"]) == (n, len(t) - len(kept))
    for (k, t), gone in zip(texts.items(), removed(list(texts.values()), 400)):
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, sha(kept))


@pytest.mark.parametrize("length,together,at_once", [(16, 1000, 1 << 20), (20, 1, 50), (40, 2, 50)])
def test_repeats_in_split_buckets(length, together, at_once, spark, monkeypatch):
    from tideline.llm import repeats

    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "SORTED", at_once)
    rng = np.random.default_rng(length)
    base = "".join(rng.choice(list("abcdé \n"), 400))
    texts = ["ab" * 60, "ab" * 7, "", base, base[:50]]
    for _ in range(50):
        cuts = rng.integers(0, 350, 3)
        texts.append("".join(base[a:a + rng.integers(1, 80)] + "".join(rng.choice(list("xyz"), 3)) for a in cuts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df, length=length).collect()}
    raw = [t.encode() for t in texts]
    assert got == {k: bytes(b for b, g in zip(raw[k], gone) if not g) for k, gone in enumerate(removed(raw, length))}


@pytest.mark.parametrize("length,together,at_once", [(4, 1000, 1 << 20), (6, 1, 50), (12, 2, 50), (50, 1000, 1 << 20)])
def test_repeated_passages_of_words(length, together, at_once, spark, monkeypatch):
    from tideline.llm import repeats

    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "SORTED", at_once)
    rng = np.random.default_rng(length)
    base = rng.choice(["a", "b", "dé", "x\u00a0y", "long-word"], 300).tolist()
    texts = [None, "", " \t ", "a " * 70, " ".join(base), "\n".join(base[:60]) + " ", " ".join(base[:60])] + ["  b c  " * 40] * 3
    for _ in range(40):
        words = [w for a in rng.integers(0, 250, 3) for w in [*base[a:a + rng.integers(1, 70)], f"w{rng.integers(0, 9)}"]]
        texts.append("".join(w + str(rng.choice([" ", "  ", "\n", "\t "])) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeats.remove_repeats(df, length=length, unit="words").collect()}
    want = without_passages([(t or "").encode() for t in texts], length)
    assert got == dict(enumerate(want))


def test_balls_hold_all_variants_within_a_flip(spark):
    from tideline.llm.simhash import _BLOCKS, balls

    fp = 0x5A5A_1234_9876_0FF1
    got = {r["key"] & (1 << 64) - 1 for r in balls(spark.createDataFrame([(fp,)], "fp long")).collect()}
    want = set()
    for k, (low, high) in enumerate(_BLOCKS):
        block = (1 << high) - (1 << low)
        base = fp & ~block | k << low
        want |= {base} | {base ^ 1 << b for b in range(64) if not block >> b & 1}
    assert got == want and len(want) == 131


def test_links_of_crowded_buckets(spark, monkeypatch):
    from tideline.llm import simhash
    from tideline.llm.components import components

    monkeypatch.setattr(simhash, "_SORTED", 500)
    rng = np.random.default_rng(5)
    prints = set()
    for size in (1, 2, 3, 40, 200) * 6:
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(size):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= np.uint64(1) << np.uint64(b)
            prints.add(int(x.view(np.int64)))
    prints = sorted(prints)
    pairs = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in pairs)
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    a = np.array(prints).view(np.uint64)
    want = unite(len(a), ((i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 3)))
    groups, found = defaultdict(set), defaultdict(set)
    for x, w in zip(prints, want):
        groups[w].add(x)
        found[root.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_odd_graphs(spark):
    from tideline.llm.components import components

    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 140)] * 2
    rest = [(200, 200), (300, 301), (301, 300)]
    root = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(chain + star + rest, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 300: 300, 301: 300}
    assert root == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, docs):
    """The rows of run(), by brute force from the stages' definitions."""
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    near = rows(spark, "op3_simhash")
    left = [k for k in sorted(docs) if re.search(r"[^\W\d_]", docs[k]["text"]) and near[k]["component_id"] == k]
    raw = [docs[k]["text"].encode() for k in left]
    texts = {k: kept.decode() for k, (kept, _) in zip(left, without_passages(raw, 50))}

    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {k for k, t in texts.items()
             if not any(tuple(words(t)[i:i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words(t))))}
    assert set(got) == clean
    assert all(got[k]["decoded_sha256"] == sha(texts[k]) for k in clean)

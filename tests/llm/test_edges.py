"""Odd inputs for every operator and stage, verbatim licence texts, tags in odd places, code-switched text."""

import json
import random
import re
import sys
from pathlib import Path

import pytest

pytest.importorskip("scenespark.llm")
sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import functions as F

from scenespark.llm import bpe, decontam, imatch, langid, licenses, pii, queries, simhash, similar, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of documents that are named like what operators return.
CLASH = ("score", "predicted", "spans", "n_words", "n_hit", "ranges", "items", "n_tokens", "token_ids", "rules", "licenses", "sentence_ids", "component_id", "fingerprint", "set", "bands", "hub")
LONG = " ".join(f"word{i % 977} Word" for i in range(40_000))
TEXTS = [None, "", " ", "word", "same text here", "same text here", LONG, LONG, "a@b.com 1.2.3.4", "MIT License", "\x00\x01 odd"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (4, "same text here", "en", "s", 14), (4, "another text", "fr", "s", 12)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", "same text here"), (None, "another text"), ("b", None), ("c", " ".join(f"word{i} word" for i in range(20)))], "item_id string, text string")


MODEL = [(1, "you vile idiot and stupid idiot"), (1, "vile stupid thing idiot"), (1, "an idiot so stupid")] * 4 + [(0, "a kind word here"), (0, "same text here"), (0, "nothing to see there")] * 8


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "simhash", "decontamination", "pii", "encoding", "licenses"])
def test_clashing_names_and_odd_rows(spark, docs, items, name):
    model = toxicity.fit(MODEL)
    run = {
        "toxicity": lambda d: toxicity.drop_toxic(spark, d, model),
        "near_dedup": lambda d: similar.drop_similar(spark, d),
        "simhash": lambda d: simhash.drop_near_duplicates(spark, d),
        "decontamination": lambda d: decontam.decontaminate(spark, d, items),
        "pii": pii.redact_pii,
        "encoding": lambda d: bpe.bpe_encode(spark, d, queries.vocabulary_path(), tuple(d.columns)),
        "licenses": licenses.scan_licenses,
    }[name]
    out = run(docs)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
    if name not in ("encoding", "licenses"):
        assert out.columns == docs.columns and all(r.score == "clash" and r.bands == "clash" for r in rows)
    want = {"toxicity": 14, "near_dedup": 8, "simhash": 8, "decontamination": 10, "pii": 14, "encoding": 14, "licenses": 14}[name]
    if name in ("near_dedup", "simhash"):  # 0 (with 1 and 2), 3, 4 or its other text, 6, 8, 9, 10, and the null id
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 3, 4, 6, 8, 9, 10] and len(rows) == want
    else:
        assert len(rows) == want
    assert run(docs.limit(0)).count() == 0


def test_repeated_id_keeps_the_same_row(spark):
    rows = [(1, f"text number {i} of many words", "en", "s", i) for i in range(20)] * 2
    kept = {tuple(similar.drop_similar(spark, spark.createDataFrame(random.Random(k).sample(rows, len(rows)), DOCS).repartition(3)).first()) for k in range(3)}
    assert len(kept) == 1


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op9", "op10"])
def test_queries_on_odd_rows(spark, docs, items, name):
    path = queries.vocabulary_path()
    run = {
        "op1": lambda d: toxicity.score_toxicity(spark, d, toxicity.fit(MODEL)),
        "op2": lambda d: simhash.near_duplicates(spark, d),
        "op3": lambda d: imatch.imatch_query(spark, d),
        "op4": lambda d: decontam.contamination(spark, d, items),
        "op6": lambda d: langid.identify_language(spark, d, langid.fit([("en", "the word here"), ("fr", "le mot ici")]), True),
        "op7": pii.pii_query,
        "op9": licenses.license_query,
        "op10": lambda d: bpe.bpe_digest(spark, d, path),
    }[name]
    rows = run(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(tuple(r)[1:])
    if name not in ("op3",):
        assert by[6] == by[7]  # equal long texts
    else:
        prints = {r.doc_id: r.fingerprint for r in rows}
        assert prints[6] == prints[7]
    assert run(docs.limit(0)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("x", "a b"), ("7", "c d"), (None, None)], "doc_id string, text string")
    assert imatch.imatch_query(spark, df).count() == 3 and simhash.near_duplicates(spark, df).count() == 3


# --- op1


def test_copies_are_compared_in_full():
    same_word = [{"aaa", f"b{i}", f"c{i}", f"d{i}"} for i in range(30)]
    assert not any(toxicity._copies(same_word))
    base = {f"w{i}" for i in range(50)}
    assert toxicity._copies([base, base - {"w1"} | {"x"}, base, {f"w{i}" for i in range(25)}]) == [False, True, True, False]


def test_a_span_covers_what_lies_between():
    import numpy as np

    toxic = np.array([0, 1, 0, 1, 0, 0, 1, 1, 0, 1], bool)
    assert toxicity._spans(toxic, [5, 8, 10]).tolist() == [0, 1, 1, 1, 0, 0, 1, 1, 0, 1]
    m = toxicity.fit(MODEL)
    assert m.chain.weights.shape[1] == 6  # own word, word before, word behind


# --- op2 against an exact search at another radius and size


def test_links_equal_all_pairs(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) & ((1 << 64) - 1) for b in base for _ in range(25)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    from scenespark.llm.components import components

    for radius, bucket in ((4, 2048), (3, 2), (2, 2048)):
        got = {r.node: r.component for r in components(simhash.links(spark, fps, radius, bucket)).collect()}
        own = {x: x for x in signed}
        for i, a in enumerate(signed):
            for b in signed[i + 1 :]:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius and own[a] != own[b]:
                    x, y = max(own[a], own[b]), min(own[a], own[b])
                    own = {k: y if v == x else v for k, v in own.items()}
        assert {x: got.get(x, x) for x in signed} == own


# --- op3


def test_likeness_follows_the_terms(spark):
    rnd = random.Random(8)
    vocab = [f"term{i}" for i in range(20_000)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rnd.choice(vocab) for _ in range(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.imatch_query(spark, df).toPandas()
    assert 0.2 < got.near_edited.mean() < 0.6 and got.near_next.mean() < 0.15 and (got.near_edited == 0).mean() < 0.1
    fp = spark.createDataFrame([(i, [int(x) for x in range(k)]) for i, k in enumerate((0, 5, 5, 6))], "i long, t array<long>").select(imatch.fingerprint_of(F.col("t"))).collect()
    assert fp[0][0] == ".".join("-" * imatch.SEEDS) and fp[1] == fp[2] and len(fp[3][0].split(".")) == imatch.SEEDS


def test_lexicon_counts_every_term(spark):
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} all") for i in range(40)], "doc_id long, text string")
    words, size = imatch.lexicon(df)
    want = {r[0] for r in df.select(F.explode(F.split("text", " ")).alias("w")).filter("w <> 'all'").select(F.xxhash64("w")).collect()}
    assert size == 120 and {r[0] for r in words.collect()} == want


def test_fingerprint_from_marks(spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(3000)], "i long, w string").select("i", F.xxhash64("w").alias("h"))
    depths = [imatch._depth(F.col("h"), s).alias(f"d{s}") for s in range(imatch.SEEDS)]
    rows = df.select("i", "h", imatch.marks(F.col("h")).alias("marks"), *depths).withColumn("bits", F.array(*imatch.spread(F.col("marks")))).collect()
    for r in rows:
        assert all(1 << (r.marks >> 4 * s & 15) == r[f"d{s}"] for s in range(imatch.SEEDS))
        assert all(r.bits[s // 4] >> 15 * (s % 4) & 0x7FFF == r[f"d{s}"] for s in range(imatch.SEEDS))
    texts = [rows[k : k + n] for n in (1, 2, 7, 100) for k in range(0, 300, 100)]
    parts = [(i, s, sorted(r.h for r in t if r[f"d{s}"] == max(x[f"d{s}"] for x in t))) for i, t in enumerate(texts) for s in range(imatch.SEEDS)]
    hashed = {(r.i, r.s): r.p for r in spark.createDataFrame(parts, "i int, s int, own array<long>").select("i", "s", F.lower(F.lpad(F.hex(F.xxhash64("own")), 16, "0")).alias("p")).collect()}
    got = spark.createDataFrame([(i, [r.h for r in t]) for i, t in enumerate(texts)], "i int, t array<long>").select("i", imatch.fingerprint_of(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: ".".join(hashed[i, s] for s in range(imatch.SEEDS)) for i in range(len(texts))}


# --- op4


def test_shards_give_the_same(spark, docs, items):
    df = docs.drop(*CLASH)
    key = lambda r: (r.doc_id is not None, r.doc_id, r.n_words, r.n_hit, r["items"])
    one = sorted(map(key, decontam.find_hits(spark, df, items).collect()), key=str)
    many = sorted(map(key, decontam.find_hits(spark, df, items, shard_bytes=10).collect()), key=str)
    assert one == many and any(r[4] == [""] for r in one)
    assert decontam.decontaminate(spark, docs, items, shard_bytes=10).count() == 10


# --- op5


def test_links_as_a_parser_sees_them():
    page = "http://h.com/a/b/c.html?q"
    of = lambda html: urlfilter.alias_targets(page, html)
    assert of('<!-- <link rel=canonical href="http://x.com/"> -->') == []
    assert of("<script>var s = '<link rel=canonical href=http://x.com/>';</script>") == []
    assert of('<a title="<link rel=canonical href=http://x.com/>">') == []
    assert of('<link title="a > b" rel="alternate Canonical" href="../d?x=1&amp;y=2">') == ["http://h.com/a/d?x=1&y=2"]
    assert of("<link rel=canonical href=/1><link rel=canonical href=/2><meta http-equiv=Refresh content=\"5; URL='//o.net/z'\">") == ["http://h.com/1", "http://h.com/2", "http://o.net/z"]
    assert of("<base href='http://base.org/x/'><meta http-equiv=refresh content='0;url=y'>") == ["http://base.org/x/y"]
    assert of("<link rel=canonical><meta http-equiv=refresh content=5><link rel=canonical href='http://[bad/'>") == []


def test_urls_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, verdict string, node string"
    rows = [(1, "http://a.com/1", "<link rel=canonical href=http://b.com/>", "c", "c", "c")] * 2 + [(None, None, None, None, None, None), (2, "http://b.com/", "x" * 100_000 + "<meta http-equiv=refresh content='0;url=http://c.net/'>", "c", "c", "c"), (3, "HTTP://B.COM", "", "c", "c", "c")]
    got = sorted(map(tuple, urlfilter.judge_urls(spark, spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "a.com", "/1", None, "block")] * 2 + [(None, "", "", None, "allow"), (2, "b.com", "/", None, "block"), (3, "b.com", "", None, "block")], key=str)


# --- op6


def test_code_switched_text():
    rnd = random.Random(4)
    en, fr = ["the", "house", "with", "another", "thing", "which", "would", "not"], ["le", "maison", "avec", "autre", "chose", "qui", "serait", "pas"]
    line = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    m = langid.fit([(y, line(ws, 60)) for y, ws in (("en", en), ("fr", fr)) for _ in range(30)])
    a, b = line(en, 12), line(fr, 9)
    (lang, score, runs), digits, letters = m.predict([a + " " + b, "12 _ ²", "x²"], True)
    assert (lang, [(r["start"], r["end"], r["lang"]) for r in runs]) == ("en", [(0, len(a), "en"), (len(a) + 1, len(a) + 1 + len(b), "fr")])
    assert digits[0] == "und" and letters[0] != "und"


# --- op7


def test_very_many_spans(spark):
    n = 20_000
    t = " ".join(f"a{i}@b.com call +1 555 {i:05d} 99" for i in range(n))
    df = spark.createDataFrame([(1, t, "é" + t[: 500])], "doc_id long, text string, other string").repartition(1)
    r = pii.pii_query(df).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    assert r.n_email == n == r.n_phone and [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")[:n]] == want
    assert pii.redact_pii(df.select("doc_id", "text")).first().text == " ".join(["<EMAIL> call <PHONE>"] * n)


def test_overlapping_spans_are_one(spark):
    t = "x +1234@567.89.12.3 y 4111 1111 1111 1111@b.com"
    got = pii.redact_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().text
    spans = sorted((s.start, s.end, s.kind) for s in pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().spans)
    out, at, end = "", 0, 0
    for a, b, k in spans:
        if a >= end:
            out += t[at if at > end else end : a] + f"<{k.upper()}>"
        end = max(end, b)
        at = end
    assert got == out + t[end:]


# --- op8


def test_warc_sizes_and_odd_rows(spark):
    rows = [(i, f"http://a.com/{i}", "x" * n, "clash") for i, n in enumerate((0, 10, 1500, 1500, 20_000, 300_000, 4_000_000))] + [(2, "http://a.com/2", "x" * 1500, "clash"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_query(spark, df).collect()), key=str)
    want = [(i, n, "response", None) for i, n in ((0, 0), (1, 10), (3, 1500), (4, 20_000), (5, 300_000), (6, 4_000_000), (None, 0))] + [(2, 1500, "revisit", 3)] * 2
    assert got == sorted(want, key=str)
    lone = spark.createDataFrame([("request", "r1", "c1"), ("metadata", "m2", "c2"), ("response", "c3", None), ("warcinfo", "w", None)], "type string, record_id string, concurrent_to string")
    assert {(r.capture_id, r.request is None, r.response is None, r.metadata is None) for r in warc.assemble_transactions(lone).collect()} == {("c1", False, True, True), ("c2", True, True, False), ("c3", True, False, True)}


# --- op9: published texts as they are wrapped

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, ("mit-text", "MIT")),
        (APACHE, ("apache-header", "Apache-2.0")),
        (BSD, ("bsd-3-text", "BSD-3-Clause")),
        (BSD.replace(BSD[BSD.index("3. ") : BSD.index("THIS")], ""), ("bsd-2-text", "BSD-2-Clause")),
        (GPL, ("gpl-3-header", "GPL-3.0-or-later")),
        (GPL.replace("version 3", "version 2"), ("gpl-2-header", "GPL-2.0-or-later")),
        (MPL, ("mpl-2-header", "MPL-2.0")),
        ("Words before.\n" + MIT.replace("\n", "\r\n") + "and after " + MIT, ("mit-text", "MIT")),
        ("// SPDX-License-Identifier: MIT\nint x;", ("spdx-MIT", "MIT")),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ("spdx-GPL-2.0-or-later", "GPL-2.0-or-later")),
        ("Licensed under the MIT license. Licensed under CC BY-SA 4.0", ("mit-licensed,cc-by-sa-notice", "CC-BY-SA-4.0,MIT")),
        ("Some text\nReleased under the MIT License\nMore", ("mit-notice", "MIT")),
        ("It was not released under the MIT License.", ("", "")),
        ("we say: the MIT licences are permissions", ("", "")),
    ],
)
def test_published_licences(spark, text, want):
    r = licenses.license_query(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.rules, r.licenses) == want


# --- the pipeline


def test_stages_on_odd_tables(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "zebra " * 13)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    out = pipeline.run(spark, str(tmp_path))
    assert set(out.columns) >= set(docs.columns) and out.count() >= 5
    json.dumps([r.n_tokens for r in out.collect()])

"""The operators of the subpackage against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("scenespark.llm")

from pyspark.sql import functions as F

from scenespark.llm import bpe, components, crf, decontam, imatch, langid, licenses, pii, queries, simhash, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "word", "Word word", "é 😀 日本", "a\tb\nc", "x " * 3000, "1" * 4000, "same text here now", "same text here now", "<|endoftext|> <CARD>"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(ODD)] + [(None, "no id", "en", None, 5), (3, "word", "en", "s", 4)]
    return spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- BPE


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib = Tokenizer.from_file(path)
    for df in (docs, odd.filter("doc_id IS NOT NULL")):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = sorted((i, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for (i, _), e in zip(texts, lib.encode_batch([t for _, t in texts], add_special_tokens=False)))
        assert sorted(map(tuple, bpe.bpe_digest(spark, df, path).collect())) == want


def test_bpe_random_pieces():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    own, lib, rnd = bpe.Bpe(json.loads(bpe.read_spec(path))), Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rnd.choice("aeiouthns '.,\n1é中\U0001f600") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += ["".join(chr(rnd.randrange(0x20, 0x2FFF)) for _ in range(60)) for _ in range(100)] + ["a" * 5000, " " * 3000]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids, _ = own.encode(t)
        assert ids.tolist() == e.ids and own.decode(ids) == t


def test_bpe_round_trip(spark, odd):
    path = queries.vocabulary_path()
    enc = bpe.bpe_encode(spark, odd.filter("doc_id <> 3"), path)
    back = {r.doc_id: r.text for r in bpe.bpe_decode(spark, enc, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD) if i != 3}


# --- the chain


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    for lens in ([1], [4, 3], [2, 1, 5]):
        n, k = sum(lens), 3
        emit, start, trans = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(k, k))
        first = np.zeros(n, bool)
        first[np.cumsum([0, *lens])[:-1]] = True
        got, pairs = crf.marginals(emit, first, start, trans)
        at, want_pairs = 0, np.zeros((k, k))
        for size in lens:
            p, total = np.zeros((size, k)), 0.0
            own = np.zeros((k, k))
            for ys in itertools.product(range(k), repeat=size):
                w = np.exp(start[ys[0]] + sum(emit[at + i, y] for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
                total += w
                for i, y in enumerate(ys):
                    p[i, y] += w
                for a, b in zip(ys, ys[1:]):
                    own[a, b] += w
            assert np.allclose(got[at : at + size], p / total)
            want_pairs += own / total
            at += size
        assert np.allclose(pairs, want_pairs)


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_toxicity(spark, odd, empty):
    bad = ["nasty", "vile", "awful"]
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        ws, y = [rnd.choice(vocab) for _ in range(40)], int(i % 3 == 0)
        for _ in range(3 * y):
            ws[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, y))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_query(spark, df, lab).collect()
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in got)
    test = [(r.predicted, labels[r.doc_id][2]) for r in got if r.held_out]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
    text = {r[0]: r[1] for r in rows}
    words = {text[r.doc_id][s.start : s.end] for r in got for s in r.spans}
    assert words & set(bad)
    model = toxicity.train(df, lab)
    scores = toxicity.score_toxicity(spark, odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score_toxicity(spark, empty, model).count() == 0
    assert toxicity.train(df, lab.limit(0)) is None
    kept = toxicity.drop_toxic(spark, odd, None)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_language(spark, docs, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_query(spark, df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    model = langid.train(df)
    out = {r.doc_id: r.lang_pred for r in langid.identify_language(spark, odd.filter("doc_id IN (0, 1, 8)"), model).collect()}
    assert set(out.values()) == {"und"}
    assert langid.identify_language(spark, odd, None).count() == odd.count()
    assert langid.language_query(spark, empty).count() == 0


# --- SimHash


def naive_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_components(prints):
    names = {f: f for f in prints.values()}

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    fs = sorted(names)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                names[max(x, y)] = min(x, y)
    groups: dict = {}
    for d, f in prints.items():
        groups.setdefault(root(f), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("bucket", [2048, 1])
def test_simhash(spark, docs, odd, bucket):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(400)]
    near = []
    for i in range(40):
        ws = list(base)
        for _ in range(i % 5):
            ws[rnd.randrange(400)] = "edit"
        near.append((10_000 + i, " ".join(ws)))
    df = docs.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(near, "doc_id long, text string")).unionByName(odd.filter("doc_id IS NOT NULL AND doc_id <> 3").select((F.col("doc_id") + 20_000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark, df, bucket=bucket).collect()}
    prints = {i: naive_fingerprint(t) for i, t in texts.items()}
    assert {i: v[0] for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == naive_components(prints)


def test_thresholds_and_empty(spark, empty, odd):
    assert simhash.allot([[0, 5, 50], [0, 1, 2], [0, 9, 90]], -1) == (2.0, [-1, 1, -1])
    cost, ts = simhash.allot([[0, 5, 50], [0, 1, 2]], 0)
    assert (cost, ts) == (2.0, [-1, 1])
    assert simhash.near_duplicates(spark, empty).count() == 0
    kept = simhash.drop_near_duplicates(spark, odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1 and kept.filter("text = 'same text here now'").count() == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1, 1), (None, 2)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    own = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and own[a] != own[b]:
                own[a] = own[b] = min(own[a], own[b])
                changed = True
    assert got == own


# --- I-Match


def test_imatch(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 7)
    for df in (docs, odd.filter("doc_id IS NOT NULL AND NOT (doc_id = 3 AND lang IS NOT NULL)")):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        ids = sorted(text)
        after = dict(zip(ids, ids[1:] + ids[:1]))
        got = {r.doc_id: r for r in imatch.imatch_query(spark, df).collect()}
        assert sorted(got) == ids
        for i, r in got.items():
            t, half = text[i], len(text[i]) // 2
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + text[after[i]][:half]).encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert all(got[a].fingerprint == got[b].fingerprint for a in ids for b in (after[a],) if text[a] == text[b])
    assert imatch.imatch_query(spark, empty).count() == 0
    assert imatch.imatch_query(spark, odd).count() == odd.count()


# --- decontamination


def naive_hits(text, items, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    ws, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(ws), len(hit), found


def test_automaton_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        letters = "abcd"[: rnd.randint(1, 4)]
        items = [(k, " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))) for k in range(rnd.randint(0, 6))]
        window = rnd.randint(1, 6)
        auto = decontam.Automaton(items, window)
        for _ in range(5):
            t = " ".join(rnd.choice(letters + "z") for _ in range(rnd.randint(0, 40)))
            ws = decontam.normalised(t)
            ranges, found = auto.match(ws)
            assert (len(ws), sum(b - a for a, b in ranges), found) == naive_hits(t, items, window)


def test_contamination(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    for shard in (4 << 20, 500):
        hits = {r.doc_id: r for r in decontam.find_hits(spark, docs, items, shard_bytes=shard).collect()}
        for r in docs.collect():
            assert (hits[r.doc_id].n_words, hits[r.doc_id].n_hit, hits[r.doc_id]["items"]) == (lambda a, b, c: (a, b, sorted(map(str, c))))(*naive_hits(r.text, pairs))
    out = decontam.contamination(spark, odd, items)
    assert out.count() == odd.count() and out.filter("contaminated").count() == 0
    assert decontam.contamination(spark, docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.contamination(spark, empty, items).count() == 0
    passage = spark.createDataFrame([(1, f"keep this {pairs[0][1]} and this", "en", "s", 0)], DOCS)
    assert decontam.decontaminate(spark, passage, items).count() == 0
    left = decontam.decontaminate(spark, passage, items, remove_spans=True).first()
    assert left.text.startswith("keep this ") and left.text.endswith(" and this") and left.n_chars == len(left.text) < 40


# --- URLs


def test_urls(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="https://b.net/y">'),
        (2, "https://b.net/y#z", None),
        (3, "http://c.com/", '<meta http-equiv="refresh" content="0; url=/q">'),
        (4, "http://c.com/q", "<LINK href='//example.net/en/1' rel='canonical'>"),
        (5, "http://c.com/q", "<link rel=canonical href=http://q.net/>"),
        (6, None, None),
        (7, "nope", "x"),
        (8, "http://E.NET", ""),
        (9, "http://example.com/de/x", '<link rel="canonical" href="http://free.com/">'),
        (10, "http://free.com", None),
        (11, "ftp://www.example.org/fr/?q#f", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.com", "/x", None, "block"),
        2: ("b.net", "/y", "net/", "block"),
        3: ("c.com", "/", None, "allow"),
        4: ("c.com", "/q", None, "allow"),
        5: ("c.com", "/q", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("e.net", "", None, "allow"),
        9: ("example.com", "/de/x", "example.com/de/", "block"),
        10: ("free.com", "", None, "block"),
        11: ("www.example.org", "/fr/", "org/fr/", "allow"),
    }
    assert urlfilter.judge_urls(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- PII


def naive_pii(t):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group())]


def test_pii(spark, docs, odd, empty):
    rnd = random.Random(6)
    texts = ["a@b.com_foo@x.yz", "é😀 a@b.c 1.2.3.4.5 01.002.0003.255 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 12 3", "+1 (663) 555-6869 +1+2+33333333", "1" * 3000, "1 " * 2000, "a" * 3000 + "@b.c", "a@b.c@d.e", "1.1.1.1.1.1.1.1", "+123456789012345 +1234567890123456"]
    texts += ["".join(rnd.choice("ab@.1234+- ()5é") for _ in range(80)) for _ in range(150)]
    df = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    source = {r.doc_id: r.text for r in df.collect()}
    for r in pii.pii_query(df).collect():
        want = naive_pii(source[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line), source[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
    more = {r.doc_id: r.spans for r in pii.pii_query(spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433"), (2, "card 378282246310005"), (3, "x 378282246310005")], "doc_id long, text string")).collect()}
    assert more == {1: "iban:5:32", 2: "short_card:5:20", 3: ""}
    assert pii.pii_query(empty).count() == 0
    clean = {r.doc_id: r for r in pii.redact_pii(odd.limit(0).unionByName(spark.createDataFrame([(1, "x 4111 1111 1111 1111 a@b.com.", "en", "s", 9, "clash"), (2, None, "en", "s", 7, "clash")], DOCS + ", spans string"))).collect()}
    assert (clean[1].text, clean[1].n_chars, clean[1].spans) == ("x <CARD> <EMAIL>.", 17, "clash")
    assert (clean[2].text, clean[2].n_chars) == (None, 7)


# --- WARC


def test_warc(spark):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.com/x?q#f", big), (2, "http://b.com", big), (3, None, "small"), (4, "http://c.com/", None), (5, "bad\r\nurl", "small"), (7, "http://d.com", big), (None, "http://e.com", "tail")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_query(spark, df).collect()}
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = 7 if h == big and i != 7 else None
        want[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", again)
    assert got == want
    path = str(warc.scratch(spark, "test-warc"))
    warc.write_warc(warc.mark_revisits(df), path)
    full = warc.assemble_transactions(warc.read_warc(spark, path)).collect()
    assert len(full) == len(rows) and all(r.request and r.response and r.metadata for r in full)
    assert {bytes(r.response.payload).decode() for r in full if r.response.type == "response"} == {big, "small", "", "tail"}
    assert warc.warc_query(spark, df.limit(0)).count() == 0


# --- licences


def test_licenses(spark, odd, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    df = spark.createDataFrame([(1, "Some text\nReleased under the MIT License.\nMore."), (2, mit), (3, mit.split("\n\n")[2] + "\n\n" + mit.split("\n\n")[0]), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.license_query(df).collect()}
    assert got == {1: ("mit-notice", "MIT"), 2: ("mit-text", "MIT"), 3: ("", ""), 4: ("cc-by-nc-notice", "CC-BY-NC-4.0")}
    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES.values())
    assert licenses.license_query(odd).count() == odd.count() and licenses.license_query(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = c.sql(queries.oracle_sql()[name])
    at = [found.columns.index(k) for k in cols]
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(str(r[k]) for k in at) for r in found.fetchall())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF)
    rows = {r.doc_id: r for r in out.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id: r.text for r in docs.collect() if not model or model.score(model.tag([r.text or ""])[1][0]) < 0.5}
    # the stage links texts whose five-word shingles have similarity 0.8 or more, not op2's fingerprints
    from test_similar import naive_keep

    kept = {i: clean[i] for i in naive_keep(clean)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in list(kept.items()):
        n, hit, _ = naive_hits(t, items)
        if hit and 20 * hit >= n:
            del kept[i]
    assert set(rows) == set(kept)
    own = bpe.Bpe(json.loads(bpe.read_spec(queries.vocabulary_path())))
    for i, r in rows.items():
        assert r.token_ids == own.encode(r.text)[0].tolist() and r.n_tokens == len(r.token_ids) and r.n_chars == len(r.text)
        if not naive_pii(kept[i]):
            assert r.text == kept[i]

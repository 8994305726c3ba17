"""Near-duplicate removal of the pipeline against exact shingle similarity."""

import itertools
import os
import random

import pytest

pytest.importorskip("scenespark.llm")

from scenespark import session
from scenespark.llm import similar, toxicity


def naive_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def naive_keep(texts):
    sets, own = {i: naive_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * len(sets[a] | sets[b]):
            x, y = own[a], own[b]
            for i in own:
                if own[i] == max(x, y):
                    own[i] = min(x, y)
    return {i for i in own if own[i] == i}


@pytest.mark.parametrize("bucket", [32, 2])
def test_planted_copies(spark, bucket):
    rnd = random.Random(11)
    texts = {}
    for k in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        texts[10 * k] = " ".join(base)
        for c in range(1, 6):  # each edited word changes five shingles
            ws = list(base)
            for _ in range(c):
                ws[rnd.randrange(200)] = f"edit{rnd.random()}"
            texts[10 * k + c] = " ".join(ws)
    a, b = naive_set(texts[0]), naive_set(texts[4])
    assert 0.8 <= len(a & b) / len(a | b) < 0.95
    texts |= {1000: "", 1001: " ", 1002: "a b", 1003: "A  b", 1004: "a b c"}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    kept = similar.drop_similar(spark, df, bucket)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == naive_keep(texts)


@pytest.mark.parametrize("bucket", [32, 2])
def test_chains(spark, bucket):
    """Each text is like the next, but the ends are like no common text."""
    rnd = random.Random(5)
    texts = {}
    for k in range(8):
        ws = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        for c in range(12):
            texts[100 * k + c] = " ".join(ws)
            ws = list(ws)
            for _ in range(3):
                ws[rnd.randrange(200)] = f"edit{rnd.random()}"
    a, b = naive_set(texts[0]), naive_set(texts[11])
    assert len(a & b) / len(a | b) < 0.5
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in similar.drop_similar(spark, df, bucket).collect()} == naive_keep(texts)


def test_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert got == naive_keep(texts)


def test_driver_gives_memory_back(spark, monkeypatch):
    """The model is fitted in another process, and the driver's heap is collected between the steps of near_dedup."""
    monkeypatch.setattr(toxicity, "labelled_sample", lambda *a: [])
    monkeypatch.setattr(toxicity, "fit", lambda sample: (os.getpid(), sample))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    pid, sample = toxicity.train(None, labels)
    assert pid != os.getpid() and sample == []
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        session.apart(lambda: 1 // 0)
    with pytest.raises(RuntimeError, match="ended early"):
        session.apart(lambda: os._exit(3))
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs, before = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(6)], "doc_id long, text string"), count()
    assert {r.doc_id for r in similar.drop_similar(spark, docs).collect()} == {0, 2, 4}
    assert count() - before >= 5

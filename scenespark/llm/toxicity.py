"""Toxic spans by a linear-chain conditional random field.

Tokens get labels from labelled documents: a word, or all words with a prefix, count as toxic where
they occur in many toxic documents and hardly in others, and a word between two such words belongs to
their span. So the label of a token depends on its neighbours: the chain's features are the word, its
prefixes and suffixes and its length, and those of the words before and after it, with learned
transitions. Forward-backward marginals tag the tokens of any text. A document's score is a logistic
function of its largest marginal, the sum of its marginals above one half and its number of words,
fitted on the same sample. Toxic documents of the sample that are near copies of each other (word sets of Jaccard
similarity NEAR or more, compared in full) count once, or they would vouch for each other's rare words.

Nulls and texts without a word get the score of no evidence (far below 0.5) and no span. Repeated
rows are scored alike. Very long texts are read whole; an Arrow batch is bounded in bytes. With no
labelled row of both kinds every score is 0. Further columns are kept by ``drop_toxic`` whatever their
names, and ignored by ``score_toxicity``; of columns kept there, those named like its own are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.llm import crf
from scenespark.llm.sampling import held_out, labelled_sample, lower, portions
from scenespark.session import apart, prepare

WORD = re.compile(r"\w+")

#: Bounds of the fitting sample: documents of each label for the statistics of words, and for the chain.
SAMPLE_DOCS, CHAIN_DOCS = {0: 2500, 1: 1200}, 300
#: A trigger occurs in so many different toxic documents at least, and so many times as often as elsewhere.
LEAST_DOCS, LEAST_RATIO = 6, 25.0
PREFIXES = (3, 4, 5, 6)
#: Words that a span may have between two toxic words.
GAP = 1
#: Toxic documents of the sample whose word sets are so similar count once.
NEAR = 0.6


def features(word: str) -> list[str]:
    n = len(word)
    return ["b", "w" + word, *("p" + word[:k] for k in PREFIXES if n > k), *("s" + word[-k:] for k in (3, 4) if n > k), f"n{min(n, 12)}"]


def _claims(word: str) -> list[str]:
    return ["w" + word, *("p" + word[:k] for k in PREFIXES[1:] if len(word) > k)]


def _evidence(p: np.ndarray) -> tuple[float, float, float, float]:
    """Of a text's marginals: the largest, the mass of those above one half, and the number of words, in which one hit by chance is likelier."""
    top, mass = (float(p.max()), float(p[p >= 0.5].sum())) if len(p) else (0.0, 0.0)
    return top, math.log1p(mass), 1.0, math.log1p(len(p))


class Model:
    def __init__(self, chain: crf.Chain, weights: tuple[float, ...]):
        self.chain, self.weights = chain, weights
        self._memory: crf.Memory | None = None

    def __getstate__(self):
        return {"chain": self.chain, "weights": self.weights, "_memory": None}

    def tag(self, texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
        """The words of each text and their probabilities of being toxic."""
        if self._memory is None:
            self._memory = crf.Memory(self.chain, features)
        words = [WORD.findall(lower(t)) for t in texts]
        line = [w for ws in words for w in ws]
        ends = np.cumsum([len(w) for w in words])
        first = np.zeros(len(line), bool)
        first[[a for a, ws in zip([0, *ends.tolist()], words) if ws]] = True
        post, _ = crf.marginals(self._memory.look_up(line, first), first, self.chain.start, self.chain.trans)
        return words, np.split(post[:, 1], ends[:-1]) if len(texts) else []

    def score(self, p: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(self.weights, _evidence(p)))))))


def _copies(sets: list[set[str]]) -> list[bool]:
    """Whether an earlier set that is itself no copy has similarity NEAR or more; min-hashes only choose whom to compare."""
    rng = np.random.default_rng(1)
    mult = rng.integers(1, 1 << 31, 64, np.uint64) * np.uint64(2) + np.uint64(1)
    prints, kept, out = np.zeros((len(sets), 64), np.uint32), [], []
    for i, words in enumerate(sets):
        h = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        own = ((h[:, None] * mult) >> np.uint64(16)).astype(np.uint32).min(0) if len(h) else prints[i]
        alike = np.flatnonzero((prints[: len(kept)] == own).mean(1) >= NEAR / 2).tolist()
        copy = any(len(words & sets[kept[j]]) >= NEAR * len(words | sets[kept[j]]) for j in alike)
        out.append(copy)
        if not copy:
            prints[len(kept)] = own
            kept.append(i)
    return out


def _spans(toxic: np.ndarray, ends: list[int]) -> np.ndarray:
    """Token labels: toxic words, and what lies between two of them within GAP words in a document."""
    gold = toxic.astype(int)
    at = np.flatnonzero(toxic)
    doc = np.searchsorted(ends, at, side="right")
    for a, b in zip(at[:-1][(np.diff(at) <= GAP + 1) & (np.diff(doc) == 0)].tolist(), at[1:][(np.diff(at) <= GAP + 1) & (np.diff(doc) == 0)].tolist()):
        gold[a:b] = 1
    return gold


def fit(sample: list[tuple[int, str]]) -> Model | None:
    """A model from (label, text) rows; none if a label is missing."""
    pool: dict[str, str] = {}
    docs = [(y, [pool.setdefault(w, w) for w in WORD.findall(text.lower())]) for y, text in sample]
    docs = [(y, words) for y, words in docs if words]
    bad = [k for k, (y, _) in enumerate(docs) if y]
    again = {k for k, copy in zip(bad, _copies([set(docs[k][1]) for k in bad])) if copy}
    docs = [d for k, d in enumerate(docs) if k not in again]
    n = [sum(y == k for y, _ in docs) for k in (0, 1)]
    if not all(n):
        return None
    counts: tuple[dict, dict] = ({}, {})
    for kind in (1, 0):  # other documents are counted for what occurs in several toxic ones
        c = counts[kind]
        for y, words in docs:
            if y == kind:
                for f in {f for w in set(words) for f in _claims(w)}:
                    if kind or f in counts[1]:
                        c[f] = c.get(f, 0) + 1
        if kind:
            for f in [f for f, k in c.items() if k < 2]:
                del c[f]
    triggers = {f for f, k in counts[1].items() if k >= min(LEAST_DOCS, max(2, n[1] // 10)) and (k + 0.5) / (n[1] + 1) >= LEAST_RATIO * (counts[0].get(f, 0) + 1.5) / (n[0] + 1)}
    if not triggers:  # small samples: the words that speak most for a toxic document
        ranked = sorted(counts[1], key=lambda f: ((counts[0].get(f, 0) + 0.5) / (n[0] + 1) / (counts[1][f] + 0.5), -counts[1][f], f))
        triggers = set(ranked[:20])
    chosen, taken = [], [0, 0]
    for y, words in docs:
        if taken[y] < CHAIN_DOCS:
            taken[y] += 1
            chosen.append((y, words))
    line = [w for _, ws in chosen for w in ws]
    first = np.zeros(len(line), bool)
    first[np.cumsum([0, *(len(ws) for _, ws in chosen)])[:-1]] = True
    known: dict[str, bool] = {}
    toxic = np.array([bool(y and (known[w] if w in known else known.setdefault(w, not triggers.isdisjoint(_claims(w))))) for y, ws in chosen for w in ws], bool)
    gold = _spans(toxic, np.cumsum([len(ws) for _, ws in chosen]).tolist())
    chain = crf.train(line, gold, first, [0, 1], features, steps=30, context=True)
    model = Model(chain, (0.0,) * 4)
    x = np.array([_evidence(p) for k in range(0, len(docs), 200) for p in model.tag([" ".join(ws) for _, ws in docs[k : k + 200]])[1]])
    y = np.array([y for y, _ in docs], float)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = np.zeros(4)
    for _ in range(60):  # Newton's method with a weak prior
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4)
        w = w + np.linalg.solve(h, x.T @ (share * (y - p)) - 1e-3 * w)
    model.weights = tuple(w.tolist())
    model._memory = None
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on at most SAMPLE_DOCS documents by label that are not held out."""
    labels = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1))
    return apart(fit, labelled_sample(docs, "toxic", SAMPLE_DOCS, labels))


SPANS = "array<struct<start:int,end:int,p:double>>"


def _scored(spark: SparkSession, docs: DataFrame, model: Model | None, spans: bool, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns keep, and __tox_score, __tox_predicted and, if asked for, __tox_spans."""
    sent = prepare(spark).sparkContext.broadcast(model)
    fields = [docs.schema[k] for k in keep] + [T.StructField("__tox_score", T.DoubleType()), T.StructField("__tox_predicted", T.IntegerType())]
    if spans:
        fields.append(T.StructField("__tox_spans", T._parse_datatype_string(SPANS)))
    schema = T.StructType(fields)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            probs = [p for part in portions(texts) for p in model.tag(part)[1]] if model else [np.zeros(0)] * len(texts)
            scores = [model.score(p) if model else 0.0 for p in probs]
            out = [*(batch.column(names.index(k)) for k in keep), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            if spans:
                found = []
                for t, p in zip(texts, probs):
                    hit = set(np.flatnonzero(p >= 0.5).tolist())
                    at = [m.span() for k, m in enumerate(WORD.finditer(lower(t))) if k in hit] if hit else []
                    found.append([{"start": a, "end": b, "p": float(p[k])} for (a, b), k in zip(at, sorted(hit))])
                out.append(pa.array(found, span_type))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)


def score_toxicity(spark: SparkSession, docs: DataFrame, model: Model | None, spans: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score, predicted and, if asked for, the toxic spans (code points, end exclusive)."""
    own = ("score", "predicted", "spans") if spans else ("score", "predicted")
    kept = tuple(k for k in keep if k not in own)
    return _scored(spark, docs, model, spans, kept).select(*kept, *[F.col(f"__tox_{c}").alias(c) for c in own])


def toxicity_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    scored = score_toxicity(spark, docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that the model calls toxic; all columns of docs."""
    return _scored(spark, docs, model, False, tuple(docs.columns)).filter("__tox_predicted = 0").select(*docs.columns)

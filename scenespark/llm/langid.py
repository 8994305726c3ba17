"""Language identification by a linear-chain conditional random field.

Each word is labelled with a language by forward-backward, so that code-switched text gets a label
per word, given as runs of words of one language; a document's language is the one with the largest
mean marginal, which is its score. Features: affixes, inner trigrams, the word itself (the lexicon)
and its length, in lower case. Transitions are learned from the training documents and from chains in
which pieces of documents of different languages follow each other, or they would learn that nobody
ever switches.

A text that is null or has no letter gets ``und`` with score 0 and no run; so does every text if no
training row has a language. Signs such as raised digits don't count as letters but do not hide the
letters beside them. Repeated rows are labelled alike; very long texts are read whole. Further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scenespark.llm import crf
from scenespark.llm.sampling import held_out, labelled_sample, lower, portions
from scenespark.session import prepare

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

#: Bounds of the fitting sample: documents and words of each language.
SAMPLE_DOCS, SAMPLE_WORDS = 150, 60_000
#: One training document in so many is cut into pieces of so many words, which switched chains mix.
SWITCHED, PIECE, PIECES = 3, (4, 25), 6


def features(word: str) -> list[str]:
    n = len(word)
    framed = f"^{word}$"
    return ["w" + word, *("p" + word[:k] for k in (1, 2, 3) if n >= k), *("s" + word[-k:] for k in (1, 2, 3) if n >= k), *{"g" + framed[i : i + 3] for i in range(n)}, f"n{min(n, 10)}"]


def words_at(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text's words in lower case, letters only."""
    found = ((m.group(), m.start(), m.end()) for m in WORD.finditer(lower(text)))
    found = ((w if w.isalpha() else "".join(c for c in w if c.isalpha()), a, b) for w, a, b in found)
    return [x for x in found if x[0]]


def words_of(text: str) -> list[str]:
    found = WORD.findall(lower(text))
    if all(map(str.isalpha, found)):
        return found
    return [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]


class Model:
    def __init__(self, chain: crf.Chain):
        self.chain = chain
        self._memory: crf.Memory | None = None

    def __getstate__(self):
        return {"chain": self.chain, "_memory": None}

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals [words, languages] of each text's words."""
        if self._memory is None:
            self._memory = crf.Memory(self.chain, features)
        words = [words_of(t) if t else [] for t in texts]
        line = [w for ws in words for w in ws]
        ends = np.cumsum([len(w) for w in words])
        first = np.zeros(len(line), bool)
        first[[a for a, ws in zip([0, *ends.tolist()], words) if ws]] = True
        post, _ = crf.marginals(self._memory.look_up(line, first), first, self.chain.start, self.chain.trans)
        return np.split(post, ends[:-1]) if len(texts) else []

    def predict(self, texts: list[str | None], runs: bool = False) -> list[tuple[str, float, list[dict]]]:
        """Language, score and, if asked for, the runs of each text."""
        out = []
        for t, p in zip(texts, self.tag(texts)):
            if not len(p):
                out.append((UNKNOWN, 0.0, []))
                continue
            mean = p.mean(0)
            k = int(mean.argmax())
            out.append((self.chain.labels[k], float(min(1.0, mean[k])), self.runs(t, p) if runs else []))
        return out

    def runs(self, text: str, p: np.ndarray) -> list[dict]:
        """Neighbouring words of one language: start, end (code points, exclusive), lang and mean marginal."""
        best, at = p.argmax(1), words_at(text)
        edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
        return [{"start": at[a][1], "end": at[b - 1][2], "lang": self.chain.labels[best[a]], "p": float(p[a:b, best[a]].mean())} for a, b in zip(edges, edges[1:])]


def _switched(chains: list[tuple[int, list[str]]]) -> list[list[tuple[int, list[str]]]]:
    """Chains of pieces (label, words): whole documents, and for some of them mixed pieces of several."""
    rng = np.random.default_rng(7)
    out, pieces = [], []
    for k, (y, words) in enumerate(chains):
        if k % SWITCHED:
            out.append([(y, words)])
            continue
        at = 0
        while at < len(words):
            end = at + int(rng.integers(*PIECE, endpoint=True))
            pieces.append((y, words[at:end]))
            at = end
    order = rng.permutation(len(pieces)).tolist()
    return out + [[pieces[i] for i in order[k : k + PIECES]] for k in range(0, len(order), PIECES)]


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """A model from (lang, text) rows."""
    labels = sorted({y for y, _ in sample})
    chains, taken = [], dict.fromkeys(labels, 0)
    for y, text in sample:
        words = words_of(text)
        if words and taken[y] < SAMPLE_WORDS:
            taken[y] += len(words)
            chains.append((labels.index(y), words))
    line, gold, starts = [], [], []
    for chain in _switched(chains):
        starts.append(len(line))
        for y, words in chain:
            line += words
            gold += [y] * len(words)
    if not line:
        return None
    first = np.zeros(len(line), bool)
    first[starts] = True
    gold_a = np.array(gold)
    share = np.bincount(gold_a, minlength=len(labels))
    chain = crf.train(line, gold_a, first, labels, features, steps=30, rate=0.2, weight=len(line) / len(labels) / np.maximum(1, share))
    return Model(chain)


def train(docs: DataFrame) -> Model | None:
    """Fits on at most SAMPLE_DOCS documents of each language that are not held out."""
    return fit(labelled_sample(docs, "lang", SAMPLE_DOCS))


RUNS = "array<struct<start:int,end:int,lang:string,p:double>>"


def identify_language(spark: SparkSession, docs: DataFrame, model: Model | None, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every document, and its runs of words of one language if asked for."""
    sent = prepare(spark).sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if runs:
        schema = schema.add("runs", T._parse_datatype_string(RUNS))
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [f for part in portions(texts) for f in model.predict(part, runs)] if model else [(UNKNOWN, 0.0, [])] * len(texts)
            out = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if runs:
                out.append(pa.array([f[2] for f in found], run_type))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def language_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = identify_language(spark, docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

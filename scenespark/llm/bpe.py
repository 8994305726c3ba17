"""Byte-level BPE encoding and decoding.

The encoder works in time linear in a piece's length: an Aho-Corasick automaton over the
vocabulary gives the longest token at each position; a token is accepted only if the pair it forms
with its left neighbour is *compatible* (the merges, applied to the two tokens' bytes, would leave
exactly these two); otherwise the next shorter token is tried, and after the last one the encoder
steps back over its left neighbour. Decoding gathers bytes through a table of offsets.

Texts: null is the empty text; every text is encoded whole, of any length. A text that holds the
string of an added token gets that token's id, as the vocabulary file demands. Repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored by ``bpe_digest``
and kept by ``bpe_encode``, but for those named like its own.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scenespark.session import prepare

#: The pre-tokenisation pattern of byte-level vocabularies (a fixed value of the file format).
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: Pieces that a worker remembers, and the bytes of the longest one; beyond these it starts anew or does
#: not remember, so that memory stays bounded.
REMEMBERED, LONGEST = 400_000, 64


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it prints, else as 256 + its rank."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with merges in rank order."""

    def __init__(self, spec: dict):
        model, byte_of = spec["model"], _printable_bytes()
        if any(k in spec and spec[k] for k in ("normalizer", "post_processor")) or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            if token not in self.added:
                self.bytes_of[i] = raw(token)
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: pair of ids -> id of the merged token, and back; ids rise with the merge's rank
        self.merged, self.parts, last = {}, {}, -1
        for a, b in merges:
            x, y = model["vocab"][a], model["vocab"][b]
            z = model["vocab"][a + b]
            if z <= last:
                raise ValueError("the ids of merged tokens must rise with the merges")
            last = z
            self.merged[x, y], self.parts[z] = z, (x, y)
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: the longest proper prefix of a token that is a token, or -1
        self.shorter = [-1] * size
        for b, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1)
        self.length = [len(b) for b in self.bytes_of]
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.offsets[1:])
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids_of_piece: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(size)]
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's bytes together ends in a, b.

        Undo the merges on both sides of the seam from the latest to the earliest; the pair fails as
        soon as a merge across the seam would have come before the merge that was undone last."""
        x, y, before, good = a, b, 1 << 60, True
        while True:
            z = self.merged.get((x, y))
            if z is not None and z < before:
                good = False
                break
            left, right = self.parts.get(x), self.parts.get(y)
            if left is None and right is None:
                break
            if right is None or left is not None and x > y:
                before, x = x, left[1]
            else:  # of equal ids the left one is merged first, so the seam must come strictly earlier
                before, y = y + 1, right[0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        if n == 1:
            return [self.id_of[piece]]
        longest = [0] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):  # ends rise, so a start's last match is its longest
            longest[end + 1 - length[i]] = i
        out: list[int] = []
        at, dead, token, left = 0, set(), longest[0], -1
        while at < n:
            end = at + length[token]
            if end not in dead:
                good = left < 0 or fits.get((left, token))
                if good is None:
                    good = self.compatible(left, token)
                if good:
                    out.append(token)
                    left, at = token, end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:  # no token fits here: another way to reach this place is needed
                dead.add(at)
                token = out.pop()
                at -= length[token]
                left = out[-1] if out else -1
                token = shorter[token]
        return out

    def learn(self, pieces: set[str]) -> None:
        known, encode = self.ids_of_piece, self.encode_piece
        if len(known) + len(pieces) > REMEMBERED:
            known.clear()
            pieces = self.latest
        for p in pieces:
            ids = array("I", encode(p.encode()) if p not in self.added else [self.added[p]]).tobytes()
            (known if len(p) <= LONGEST else self.long)[p] = ids

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; the strings of added tokens stand alone."""
        if self.split_added is None or not any(t in text for t in self.added):
            return PIECES.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [part] if k % 2 else PIECES.findall(part)
        return out

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """ids, and the ids in decimal joined by commas."""
        found = self.pieces(text)
        self.latest = set(found)
        known = self.ids_of_piece
        new = {p for p in self.latest if p not in known}
        self.long: dict[str, bytes] = {}
        if new:
            self.learn(new)
        if self.long:
            own = self.long
            ids = np.frombuffer(b"".join(own[p] if p in own else known[p] for p in found), np.uint32)
        else:
            ids = np.frombuffer(b"".join(map(known.__getitem__, found)), np.uint32)
        return ids, ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered through the table of offsets."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        total = int(size.sum())
        if not total:
            return b""
        step = np.repeat(start - (np.cumsum(size) - size), size)
        return self.pool[step + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _loaded(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def read_spec(vocabulary: str) -> str:
    """The vocabulary file, read on the driver; it is a few MB and does not grow with the data."""
    with open(vocabulary, encoding="utf-8") as f:
        return f.read()


def _text(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.names.index(name)).to_pylist()]


def bpe_digest(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document's encoding and its decoding."""
    spec = prepare(spark).sparkContext.broadcast(read_spec(vocabulary))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in _text(batch):
                ids, decimal = bpe.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bpe_encode(spark: SparkSession, docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens and token_ids (array of int) of each document; kept columns of these two names are replaced."""
    keep = tuple(k for k in keep if k not in ("n_tokens", "token_ids"))
    spec = prepare(spark).sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in batches:
            found = [bpe.encode(t)[0].astype(np.int32) for t in _text(batch)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)))
            kept = [batch.column(batch.schema.names.index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends).astype(np.int64)), ids], [*keep, "n_tokens", "token_ids"])

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def bpe_decode(spark: SparkSession, encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of documents given as doc_id, token_ids; null ids give the empty text."""
    spec = prepare(spark).sparkContext.broadcast(read_spec(vocabulary))
    kind = encoded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], np.uint32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "token_ids").mapInArrow(run, schema)

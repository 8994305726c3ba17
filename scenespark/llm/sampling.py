"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Held-out rows: those whose crc32(doc_id as text) mod 5 is 0 are never learned from.
FOLDS = 5
#: Different labels that are learned at most: the most frequent ones, ties by name.
MOST_LABELS = 64
#: Code points of a text that may be in the sample; longer documents are not learned from.
MOST_CHARS = 200_000


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold for the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def portions(texts: list[str | None], most: int = 1 << 20) -> list[list[str | None]]:
    """The texts in lists of at most so many code points, or of one longer text: what is tagged at a time."""
    out, held = [], 0
    for t in texts:
        n = len(t or "")
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(t)
        held += n
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, label: str, most: int | dict, labels: DataFrame | None = None) -> list[tuple]:
    """(label, text) of at most ``most`` rows of each label (a number, or one by label) that are not held out.

    docs: doc_id, text and, unless ``labels`` (doc_id, label) is given, the label. Rows are chosen
    by a hash of doc_id, the same ones each time; rows without a label or text are left out, so are
    texts beyond MOST_CHARS and labels beyond the MOST_LABELS most frequent. So the sample has at most
    MOST_LABELS * most rows of MOST_CHARS, whatever the table holds. Only the chosen rows' texts reach
    the driver; their ids are the only thing that is broadcast."""
    source = docs if labels is None else labels
    rows = source.filter(~held_out() & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()}
    if not counts:
        return []
    grain, bound = 1 << 20, lambda k: most[k] if isinstance(most, dict) else most
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, min(grain, int(1.25 * bound(k) * grain / n))))])
    picked = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(grain))).filter(F.col("_h") < share[F.col(label)])
    if labels is not None:
        picked = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", label, "_h")), "doc_id")
    found = picked.filter(F.char_length("text") <= MOST_CHARS).select("_h", "doc_id", label, "text").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    taken: dict = {}
    out = []
    for r in found:
        if taken.get(r[2], 0) < bound(r[2]):
            taken[r[2]] = taken.get(r[2], 0) + 1
            out.append((r[2], r[3]))
    return out

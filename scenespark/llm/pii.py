"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Only DataFrame functions: for each kind, ``regexp_extract_all`` gives the matches of a pattern and
``split`` by the same pattern gives what lies between them, so running lengths are the offsets and the
words nearby are ends of what lies between. Running values go block by block (``_scan``), and redaction
cuts a text into blocks before it cuts spans, so that a text with very many spans takes no time in the
square of their number.
The patterns are anchored to places where a match can begin and use possessive repetition, so that
they find the same leftmost matches as the plain ones without trying every place of a long run and
without recursion.

Kinds: email, ip, card (Luhn), phone, and beyond them iban (mod-97) and, where a word nearby names
it, short_card (13 to 15 digits passing Luhn). A span is (kind, start, end, score), in code points,
end exclusive. Null texts count as empty and have no span; overlapping spans of different kinds are
all reported, and redaction merges them. Repeated rows give repeated results; further columns are kept
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far from a span a word of context counts, in code points; it does not reach beyond the neighbouring
#: match of the same pattern.
NEARBY = 40
#: Elements of a block, and of a block of blocks.
BLOCK, LARGE = 128, 8192
#: Spans of these kinds are kept whatever their score.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Further spans need this score.
LEAST_SCORE = 0.6

# Patterns: fixed values. (?:\G|...) also lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?:[0-9]{2,}+|[0-9][\x20-][0-9]++)(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# An IBAN's country fixes its length, so that it ends there whatever word follows; a code that is not
# in the register takes as much as it can.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK|FI|FK|FO|GL|NL|SD",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST",
    26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE",
    31: "MT|SC",
    32: "LC",
    33: "RU",
}
_FIXED = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_FIXED}|{_OTHER})(?![A-Za-z0-9])"

#: Score of a confirmed span, and words nearby that raise it.
KINDS = {
    "email": (0.9, r"(?i)mail|contact|write"),
    "ip": (0.7, r"(?i)\bip\b|host|server|address"),
    "card": (0.8, r"(?i)card|visa|credit|payment"),
    "phone": (0.8, r"(?i)phone|call|tel|mobile"),
    "iban": (0.8, r"(?i)iban|account|bank"),
    "short_card": (0.4, r"(?i)card|visa|credit|payment"),
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; call it on bounded strings only."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits hold."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + (c - 55)) % 97).otherwise((r * 10 + (c - 48)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "short_card":
        return F.when(n.between(13, 15), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


#: Per pattern: its kinds, and a cheap test that any text with a match passes.
PROPOSALS = (
    (EMAIL, ("email",), "@"),
    (IP, ("ip",), r"[0-9]\.[0-9]"),
    (CARD, ("card", "short_card"), r"[0-9][\x20-]?[0-9]"),
    (PHONE, ("phone",), r"\+[0-9]"),
    (IBAN, ("iban",), r"[A-Z]{2}[0-9]{2}"),
)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(rows: Column, size: int) -> Column:
    """An array (a column or a bound value: it is named twice) as an array of arrays of so many elements."""
    n = F.size(rows)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(rows, i, F.lit(size)))


def _scan(rows: Column, kind: str, step, total, join) -> Column:
    """The values (of SQL type kind) that step(carry, row) -> (carry, value) gives along an array; the carry begins at 0.

    Appending and slicing copy an array, so blocks are cut from larger blocks, the carry at the head of each block
    comes from the blocks' totals (joined by ``join``), and values are appended within blocks only."""

    def within(head: Column, block: Column) -> Column:
        def one(s: Column, x: Column) -> Column:
            nxt, value = step(s["carry"], x)
            return F.struct(nxt.alias("carry"), F.array_append(s["out"], value).alias("out"))

        return F.aggregate(block, F.struct(head.alias("carry"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda s: s["out"])

    def heads(totals: Column) -> Column:
        begin = F.struct(F.lit(0).alias("carry"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(totals, begin, lambda s, t: F.struct(join(s["carry"], t).alias("carry"), F.array_append(s["out"], s["carry"]).alias("out")), lambda s: s["out"])

    blocks = _bound(rows, lambda r: F.flatten(F.transform(_blocks(r, LARGE), lambda b: _blocks(b, BLOCK))))
    return _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, heads(F.transform(bs, total)), lambda b, h: within(h, b))))


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _placed(found: Column, gaps: Column, kinds: tuple[str, ...]) -> Column:
    """array<SPAN>: the confirmed matches with scores; gaps: the strings before, between and behind the matches."""

    def verdict(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(kinds):
            out = F.when(_confirmed(k, m), F.lit(k)).otherwise(out)
        return out

    def one(m: Column, i: Column) -> Column:
        before, behind = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
        return F.struct(F.length(before).alias("gap"), F.length(m).alias("size"), _bound(verdict(m), lambda k: F.struct(k.alias("kind"), _score(k, before, behind, kinds).alias("score"))).alias("v"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + x["gap"]
        return a + x["size"], F.struct(x["v"]["kind"].alias("kind"), a.alias("start"), (a + x["size"]).alias("end"), x["v"]["score"].alias("score"))

    spans = _scan(F.transform(found, one), SPAN, step, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]), lambda at, n: at + n)
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS) | (s["score"] >= LEAST_SCORE))


def _score(kind: Column, before: Column, behind: Column, kinds: tuple[str, ...]) -> Column:
    """The score of a match: its kind's, and more where words nearby speak for it; null without a kind."""
    around = F.concat(F.right(before, F.lit(NEARBY)), F.lit(" "), F.substring(behind, 1, NEARBY))
    out = F.lit(None).cast("double")
    for k in kinds:
        base, words = KINDS[k]
        out = F.when(kind == k, F.when(around.rlike(words), F.lit(min(1.0, base + 0.2))).otherwise(F.lit(base))).otherwise(out)
    return out


def find_pii(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with a column of spans, by kind as in KINDS, then by start.

    Each step has columns of its own, so that no pattern is searched twice."""
    kept = [c for c in docs.columns if c != into]
    df = docs.withColumn("__pii_t", F.coalesce(F.col(text), F.lit("")))
    t, n = F.col("__pii_t"), range(len(PROPOSALS))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__pii_f{k}": F.when(t.rlike(hint), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none) for k, (pattern, _, hint) in enumerate(PROPOSALS)})
    df = df.withColumns({f"__pii_g{k}": F.when(F.size(f"__pii_f{k}") > 0, F.split(t, PROPOSALS[k][0])).otherwise(none) for k in n})
    df = df.withColumns({f"__pii_p{k}": F.when(F.size(f"__pii_f{k}") > 0, _placed(F.col(f"__pii_f{k}"), F.col(f"__pii_g{k}"), PROPOSALS[k][1])).otherwise(F.array().cast(f"array<{SPAN}>")) for k in n})
    df = df.withColumn("__pii_s", F.concat(*[F.col(f"__pii_p{k}") for k in n]))
    of = lambda kind: F.filter("__pii_s", lambda s: s["kind"] == kind)
    return df.select(*kept, F.concat(*[of(k) for k in KINDS]).alias(into))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_query(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """array<struct<start, end, kind>> in order, none overlapping another: overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))
    # a span begins a group if none before it reaches beyond its start
    reach = "struct<start:int,reach:int,fresh:boolean,kind:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        far = F.greatest(at, -x["neg_end"])
        return far, F.struct(x["start"].alias("start"), far.alias("reach"), (x["start"] >= at).alias("fresh"), x["kind"].alias("kind"))

    return _grouped(_scan(ordered, reach, step, lambda b: F.aggregate(b, F.lit(0), lambda n, x: F.greatest(n, -x["neg_end"])), F.greatest))


def _grouped(rows: Column) -> Column:
    """The groups of rows (start, reach, fresh, kind): a group's end is the reach of the row before the next fresh one."""

    def ends(r: Column) -> Column:
        last = F.filter(F.transform(r, lambda x, i: F.struct(x["reach"].alias("end"), ((i + 1 == F.size(r)) | F.coalesce(F.get(r, i + 1)["fresh"], F.lit(True))).alias("last"))), lambda x: x["last"])
        return F.zip_with(F.filter(r, lambda x: x["fresh"]), last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"), a["kind"].alias("kind")))

    return _bound(rows, ends)


def _replaced(text: Column, base: Column, groups: Column, sizes: tuple[int, ...]) -> Column:
    """text, whose first code point has the place base in the document, up to the last group's end, with the
    groups replaced; first cut into stretches that hold so many groups each."""
    if not sizes:
        pieces = F.transform(groups, lambda g, i: F.concat(_between(text, F.when(i == 0, base).otherwise(F.get(groups, i - 1)["end"]) - base, g["start"] - base), F.lit("<"), F.upper(g["kind"]), F.lit(">")))
        return F.array_join(pieces, "")

    def stretch(block: Column, i: Column, blocks: Column) -> Column:
        low = F.when(i == 0, base).otherwise(F.element_at(F.get(blocks, i - 1), -1)["end"])
        return _bound(low, lambda a: _bound(_between(text, a - base, F.element_at(block, -1)["end"] - base), lambda part: _replaced(part, a, block, sizes[1:])))

    return _bound(_blocks(groups, sizes[0]), lambda blocks: F.array_join(F.transform(blocks, lambda b, i: stretch(b, i, blocks)), ""))


def _between(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by its kind in angle brackets; n_chars follows the text.

    Spans that overlap are replaced together, under the kind of the one that begins first."""
    df = find_pii(docs, into="__pii_spans").withColumn("__pii_groups", _merged(F.col("__pii_spans")))
    some, t = F.size("__pii_groups") > 0, F.col("text")
    rest = F.substring(t, F.element_at(F.col("__pii_groups"), -1)["end"] + 1, F.length(t))
    clean = F.concat(_replaced(t, F.lit(0), F.col("__pii_groups"), (LARGE, BLOCK)), rest)
    out = df.withColumn("text", F.when(some, clean).otherwise(t))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

"""IBANs before words, capitals and numbers."""

import pytest

pytest.importorskip("scenespark.llm")

from scenespark.llm import pii

DE, GB, NO = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"


def test_iban_before_a_capital_or_number(spark):
    after = [" The bank", " Please call", " BANK", " 12 times", " 7", " A", " or", ".", "", f" {NO}", "\nNext"]
    cases = [(f"IBAN {iban}{rest}", iban) for iban in (DE, GB, NO) for rest in after]
    df = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars int")
    spans = {r.doc_id: r.spans for r in pii.pii_query(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    for i, (text, iban) in enumerate(cases):
        assert f"iban:5:{5 + len(iban)}" in spans[i].split(","), text
        assert iban not in clean[i] and clean[i].startswith("IBAN <IBAN>"), text


def test_not_an_iban(spark):
    bad = ["IBAN DE88370400440532013000 The", "IBAN DE89370400440532013000X", "IBAN DE8937040044053201300 The", "IBAN xDE89370400440532013000"]
    df = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    assert all("iban" not in r.spans for r in pii.pii_query(df).collect())


def test_codes_outside_the_register(spark):
    codes = [f"QQ{k:02d}123456789012345" for k in range(2, 99)]
    body = next(c for c in codes if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1)
    df = spark.createDataFrame([(1, f"IBAN {body} or"), (2, f"IBAN {body} The bank")], "doc_id long, text string")
    assert all(f"iban:5:{5 + len(body)}" in r.spans.split(",") for r in pii.pii_query(df).collect())

"""op7 against a plain Python search."""

import hashlib
import re

import pytest

from kernelspark.llm import pii

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v // 10 + v % 10
    return s % 10 == 0


def brute(text):
    out = []
    for rank, k in enumerate(KINDS):
        for m in re.finditer(PATTERNS[k], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if k == "ip" else False,
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), rank, m.end(), k))
    return sorted(out)


TEXTS = [
    None, "", " ", "plain words only",
    "a@b.c_d@e.f x@y.z.", "mail me: joe.bloggs+x@mail-1.example.co.uk, or é@x.y and 𝔸𝔸 z%q@a-b.c",
    "@a.b a@b a@.b a.b@c..d a@b.c.d.e", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 01.002.0003.255 1.2.3 999.1.1.1.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4047054433953522 5500005555555559 00000000000000",
    "call +1 (386) 555-3733 or +44.20.7946.0958. +1 2 +123456789012345678 ++1 (2) 345-678-90123 +1 ((((",
    "12 34-56  78", "x" * 3000 + "@", "1" * 4000, "a@" * 500 + "b.c", ".".join("1" * 50), "a" + ".b" * 5000 + "@c" + ".d" * 5000,
    "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001 GB82WEST12345698765432",
    "SSN 123-45-6789, code 123-45-6789x", "phone (386) 555-3733, nothing here (386) 555-3733" + " " * 60 + "(386) 555-3733",
]


@pytest.fixture(scope="module")
def report(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, TEXTS[4], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    return pii.pii_report(df).collect()


def test_base_spans_match_plain_search(report):
    assert len(report) == len(TEXTS) + 2
    for r in report:
        want = brute(TEXTS[r.doc_id if r.doc_id is not None else 4])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[3] == k for w in want) for k in KINDS], (r, want)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_added_kinds_need_checksum_or_context(report):
    by = {r.doc_id: r for r in report}
    ibans = by[TEXTS.index(next(t for t in TEXTS if t and t.startswith("iban")))].spans.split(",")
    assert [s.split(":")[0] for s in ibans] == ["iban", "iban"]      # the one with wrong check digits is out
    assert by[len(TEXTS) - 2].spans == "ssn:4:15"
    # context ends at the neighbouring match: the second and third number have no word of theirs
    assert by[len(TEXTS) - 1].spans == "local_phone:6:20"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.pii_report(df).count() == 0


def test_documents_match_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.pii_report(docs).collect():
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = pii.pii_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all(") <= 3 * len(pii.KINDS)


def test_ibans_in_sentences(spark):
    de, gb, be = "DE89370400440532013000", "GB82WEST12345698765432", "BE68 5390 0754 7034"
    texts = {f"{de} Please pay": [de], "to DE89 3704 0044 0532 0130 00 Bank of X": ["DE89 3704 0044 0532 0130 00"], f"{de} I will": [de],
             f"{de} {gb}": [de, gb], f"é𝔸 {be} {de} {gb} 12 A": [be, de, gb], "DE89370400440532013001 A": [], f"BE12 {gb[:4]} {gb[4:]} A": [f"{gb[:4]} {gb[4:]}"],
             "BE12 GB82 WEST 1234 5698 7654 32": ["GB82 WEST 1234 5698 7654 32"], f"{de}X {de}x {de}": [de], f"x{de} {de[:-1]} A": []}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find_pii(df).collect():
        t = list(texts)[r.doc_id]
        assert [t[s.start:s.end] for s in r.spans if s.kind == "iban"] == texts[t], t

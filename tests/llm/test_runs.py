"""op12: Lyndon words, runs and digests against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kernelspark.llm import runs as R
from kernelspark.llm.queries import QUERIES


def lyndon_plain(x):
    out = []
    for i in range(len(x)):
        out.append(max(k for k in range(1, len(x) - i + 1) if all(x[i:i + k] < x[j:i + k] for j in range(i + 1, i + k))))
    return out


def runs_plain(x, least=R.MIN_WORDS, periods=R.MIN_PERIODS):
    """All maximal stretches with smallest period q, straight from the definition."""
    n, found = len(x), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, periods * q):
                found.setdefault((s, i + q - s), q)      # smaller periods come first
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        x = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(0, 4)):
            w = [r.randrange(r.choice((2, 3, 50))) for _ in range(r.randrange(1, 12))]
            w = w * r.randrange(1, 7) + w[:r.randrange(len(w))]
            w = w * r.choice((1, 1, 3, 4))
            at = r.randrange(len(x) + 1)
            x[at:at] = w
        yield x


@pytest.mark.parametrize("seed", range(3))
def test_lyndon_words_of_both_orders(seed):
    for x in sequences(150, seed):
        for y in (x, [-v for v in x]):
            group, length = R.lyndon_groups(y)
            assert length == lyndon_plain(y)
            word = {}
            for i, (g, k) in enumerate(zip(group, length)):
                assert word.setdefault(g, y[i:i + k]) == y[i:i + k]
            assert len({tuple(w) for w in word.values()}) == len(word)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_complete(seed):
    some = 0
    for x in sequences(400, 10 + seed):
        want = runs_plain(x)
        assert R.word_runs(np.array(x, np.int64)) == want and R.text_runs(x) == want
        some += bool(want)
    assert some > 50


def test_shorter_limits_need_no_other_code(monkeypatch):
    monkeypatch.setattr(R, "MIN_WORDS", 3)
    for x in sequences(300, 5):
        assert R.word_runs(np.array(x, np.int64)) == runs_plain(x, 3)


def test_long_texts():
    assert R.text_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    fib = "a", "ab"
    while len(fib[1]) < 20_000:
        fib = fib[1], fib[1] + fib[0]
    got = R.text_runs(list(fib[1][:3000]))
    assert got == runs_plain(fib[1][:3000])
    words = [str(i) for i in range(30_000)]
    assert R.text_runs(words + words) == [] and R.text_runs(words * 3) == [(0, 90_000, 30_000)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = runs_plain(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = [None] * 4
    for s, k, q in runs:
        if best[0] is None or k * best[2] > best[1] * q:
            best = [s, k, q, 1000 * k // q]
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode(),
                                                      b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, *digest)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_edge_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    line = "und so weiter, und so fort. " * 12
    rows = [(0, None, "x"), (1, "", "x"), (2, " \n\t ", "x"), (3, line + "\x0b end    ", "x"), (3, line, "x"), (3, line, "x"),
            (None, line, None), (ids[0], "one", "x"), (ids[1], "a b c d " * 30, "x"), (ids[2], "w " * 3000 + line * 20, "x"),
            (ids[3], None, "x"), (5, "x y " * 12, "x"), (6, ("p q r " * 8 + "z ") * 4, "x"), (7, "a b " * 15 + "c d " * 15, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    out = R.run_report(df)
    assert out.columns == COLUMNS
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((expected(*r[:2]) for r in rows), key=str)
    assert R.run_report(df.limit(0)).count() == 0
    kept = {r.doc_id: r.collapsed for r in R.repeated_runs(df.where("doc_id = 5")).collect()}
    assert kept == {5: "x y"}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op12_periodic_runs"](spark, sf)
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert out.columns == COLUMNS and len(got) == len(docs)
    assert out.schema["exponent_milli"].dataType.simpleString() == "bigint"
    for d in docs:
        if len(d.text) < 6000:
            assert got[d.doc_id] == expected(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in got.values()) > 80

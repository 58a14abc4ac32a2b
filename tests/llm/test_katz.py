"""op2 against a dictionary implementation, orders 1 to 3, and its exact normalisation."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from kernelspark.llm import katz

START, END = "<start>", "<end>"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    def __init__(self, docs, order):
        self.order, self.c = order, [Counter() for _ in range(order)]
        for t in docs:
            line = [START, *tokens(t)]
            for i in range(1, len(line)):
                for m in range(order):
                    if i - m >= 0:
                        self.c[m][tuple(line[i - m:i + 1])] += 1
        self.d = [katz.discounts([0, *[sum(v == r for v in c.values()) for r in range(1, katz.DISCOUNT_TO + 2)], 0])
                  for c in self.c]
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        kept = sum(self.factor(0, v) * v for v in self.c[0].values())
        self.total = self.n if self.n - kept > 1e-9 else self.n + 1
        self.unknown = (self.total - kept) / self.total
        self.after = [None] + [defaultdict(list) for _ in range(1, order)]
        for m in range(1, order):
            for g in self.c[m]:
                self.after[m][g[:-1]].append(g[-1])

    def factor(self, m, c):
        return self.d[m][min(c, katz.DISCOUNT_TO + 1)]

    def p(self, w, h):
        if not h:
            c = self.c[0][(w,)]
            return self.factor(0, c) * c / self.total if c else self.unknown
        m = len(h)
        seen = self.after[m].get(h)
        if not seen:
            return self.p(w, h[1:])
        total = sum(self.c[m][(*h, x)] for x in seen)
        kept = sum(self.factor(m, self.c[m][(*h, x)]) * self.c[m][(*h, x)] for x in seen)
        rest = 1 - sum(self.p(x, h[1:]) for x in seen)
        divisor = total if total - kept > 1e-9 * total else total + 1
        if rest <= 1e-12:
            divisor = kept
        c = self.c[m][(*h, w)]
        if c:
            return self.factor(m, c) * c / divisor
        return (divisor - kept) / divisor / rest * self.p(w, h[1:])

    def score(self, t):
        line, s = [START, *tokens(t)], 0.0
        for i in range(1, len(line)):
            s += math.log10(max(self.p(line[i], tuple(line[max(0, i - self.order + 1):i])), 1e-300))
        return s


ROWS = [(0, "the cat sat on the mat"), (1, "the cat ate the rat"), (2, None), (3, ""), (4, "The CAT sat"), (5, "a b a b a b a b c"),
        (6, "unknown words here only"), (7, "the mat"), (8, "the mat"), (8, "the mat"), (None, "the rat sat on the cat"),
        (9, "x " * 3000), (10, "É é\x0bthe\x1fcat   mat"), (11, "the cat sat on the rat")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_dictionaries(spark, order):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id bigint, text string, score double").repartition(3)
    plain = Plain([t for i, t in ROWS if not is_held(i)], order)
    got = katz.katz_scores(df, order=order).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        t = tokens(texts[r.doc_id])
        assert r.held_out == is_held(r.doc_id) and r.n_tokens == len(t) and r.train_tokens == plain.n
        assert r.n_known == sum(plain.c[0][(w,)] > 0 for w in t)
        base = sum(math.log10((plain.c[0][(w,)] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in t)
        assert r.base_score == pytest.approx(base, abs=1e-5)
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-4, rel=1e-7)


@pytest.mark.parametrize("order", [2, 3])
def test_every_history_sums_to_one(order):
    plain = Plain([t for _, t in ROWS], order)
    words = [g[0] for g in plain.c[0]] + ["never seen"]
    for m in range(1, order):
        for h in [*plain.after[m], ("never seen",) * m]:
            assert sum(plain.p(w, h) for w in words) == pytest.approx(1, abs=1e-9)


def test_documents_match_and_beat_base(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    plain = Plain([r.text for r in rows if not is_held(r.doc_id)], 2)
    got = {r.doc_id: r for r in katz.katz_scores(docs.repartition(4)).collect()}
    for r in rows[::5]:
        assert got[r.doc_id].score == pytest.approx(plain.score(r.text), abs=1e-3, rel=1e-7)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_count_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    t = katz.train_katz(df, ~katz.held_out())
    plain = Plain([x for i, x in ROWS if not is_held(i)], 2)
    for m in (0, 1):
        counts = sorted(r["count"] for r in t.ngrams().filter(f"m = {m}").collect())
        assert counts == sorted(plain.c[m].values())


def test_without_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert katz.katz_scores(df).count() == 0
    held = next(i for i in range(100) if is_held(i))
    r = katz.katz_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert r.score == 0 and r.train_tokens == 0 and r.n_known == 0


def test_query_scores_trigrams(spark):
    from kernelspark.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    plain = Plain([r.text for r in rows if not is_held(r.doc_id)], 3)
    got = {r.doc_id: r for r in QUERIES["op2_katz"](spark, folder).collect()}
    for r in rows[::10]:
        assert got[r.doc_id].score == pytest.approx(plain.score(r.text), abs=1e-3, rel=1e-7)


def test_one_text_longer_than_a_block(spark):
    """More than BLOCK_TOKENS tokens in one document, columns called like the operator's own."""
    n = katz.BLOCK_TOKENS // 3 + 1000
    learned = next(i for i in range(100) if not is_held(i))
    held = next(i for i in range(100) if is_held(i))
    rows = [(learned, "a b c " * n + "d", 1, "m"), (held, "b c a c b d", 2, "m"), (held + 1000, "c", 3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, m string")
    plain = Plain([t for i, t, *_ in rows if not is_held(i)], 3)
    for r in katz.katz_scores(df, order=3).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.n_tokens == len(tokens(text)) and r.train_tokens == plain.n
        if r.doc_id != learned:
            assert r.score == pytest.approx(plain.score(text), abs=1e-5, rel=1e-6)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_hot_words_spread_over_ranges(spark, monkeypatch, order):
    """Histories of words above HOT_TOKENS meet across ranges, order by order."""
    monkeypatch.setattr(katz, "HOT_TOKENS", 2)
    monkeypatch.setattr(katz, "RANGE_TOKENS", 300)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    t = katz.train_katz(df, ~katz.held_out(), order=order)
    plain = Plain([x for i, x in ROWS if not is_held(i)], order)
    assert t.given is not None and t.layout.parts > 5
    assert len({g for g, r in t.grams.collect() if "grams" in r and g >= t.layout.parts}) > 2
    for m in range(order):
        assert sorted(r["count"] for r in t.ngrams().filter(f"m = {m}").collect()) == sorted(plain.c[m].values())
    texts = dict(ROWS)
    got = katz.katz_scores(df, order=order).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-4, rel=1e-7)


def test_disk_of_the_trigram_model(spark):
    """Shuffle files and tables of a run stay below four times the input."""
    import os

    from kernelspark.llm.queries import QUERIES
    from kernelspark.session import checkpoint_dir
    folder = "/root/testdata/sf0.01"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tables = checkpoint_dir(spark).removeprefix("file:")

    def used():
        shuffled = {f.getPath(): f.length() for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size()))}
        return shuffled | {p: os.path.getsize(p) for d, _, names in os.walk(tables) for p in (os.path.join(d, x) for x in names)}
    before = used()
    rows = QUERIES["op2_katz"](spark, folder).collect()
    new = {p: n for p, n in used().items() if p not in before}
    assert len(rows) == 1000 and sum(new.values()) > 0
    assert sum(new.values()) < 4 * os.path.getsize(f"{folder}/documents.parquet")

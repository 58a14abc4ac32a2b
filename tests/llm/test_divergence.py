"""op6: base counts against plain Python, distances, verdicts, edge rows."""

import math
import re
from collections import Counter

import numpy as np

from kernelspark.llm import divergence as D

DIR = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = bad = good_kept = bad_kept = 0
    for r in D.divergence_rules(docs).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert 0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1 and not (r.kept and r.base_failed)
        if not r.base_failed and r.n_words >= 100:
            if labels.get(r.doc_id) == 1:
                good, good_kept = good + 1, good_kept + r.kept
            elif labels.get(r.doc_id) == 0:
                bad, bad_kept = bad + 1, bad_kept + r.kept
    assert good_kept >= 0.98 * good and bad_kept <= 0.1 * bad and bad > 10


def test_distance_is_jensen_shannon():
    p, q = np.array([[0.5, 0.5, 0.0], [1, 0, 0], [0, 0, 0], [0.2, 0.3, 0.5]]), np.array([0.2, 0.3, 0.5])

    def plain_distance(a, b):
        m = [(x + y) / 2 for x, y in zip(a, b)]
        kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, m) if x)
        return math.sqrt((kl(a) + kl(b)) / 2)
    d = D.distance(p, q)
    assert np.allclose(d[[0, 1]], [plain_distance(p[0], q), plain_distance(p[1], q)]) and d[2] == 0 and abs(d[3]) < 1e-7


def test_edge_rows(spark):
    prose = "the cat and the dog of a house in the town is that it was for me on a day " * 8
    rows = [(i, prose + f" word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(60)), "en", 1) for i in range(20)]
    rows += [(50, None, "en", 1), (51, "", None, 1), (52, "a b c " * 5, "xx", 1), (53, "é" * 200000, "en", 1), (None, prose, None, 1),
             (54, "\n a \n\x0b\n a \n", "en", 1), (54, "\n a \n\x0b\n a \n", "en", 1), (55, "#### $$$ " * 60 + " ".join(f"q{j}##" for j in range(90)), "en", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int").repartition(3)
    got = D.divergence_rules(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
    assert by[50].base_failed and by[52].class_distance is None and not by[52].kept
    assert D.divergence_rules(df.limit(0)).count() == 0

"""op1: held-out accuracy, what the fit may see, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from kernelspark.llm import quality as Q

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs, labels).join(labels, "doc_id", "left").cache()
    assert got.count() == docs.count()
    r = got.filter("held_out AND quality IS NOT NULL").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"),
        F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.first("prior"), F.min("score"), F.max("score")).first()
    assert r[1] > 1000 and r[0] > 0.97 and r[2] > 0.98
    assert abs(r[3] - 0.86) < 0.08 and 0 <= r[4] and r[5] <= 1


def test_only_training_labels_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.quality_scores(docs.withColumn("source", F.lit("x")).repartition(3), changed).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_risk_of_a_known_mixture():
    """Positives and a mixture in one statistic: the fit separates them and the prior comes out."""
    rng = np.random.default_rng(1)

    def rows(n, good):
        x = np.zeros((n, Q.N_RAW))
        x[:, 0] = np.where(good, 0.9, 0.1) + rng.normal(0, 0.03, n)
        return np.clip(x, 0, 1)
    pos, mix = rows(2000, np.ones(2000, bool)), rows(6000, rng.random(6000) < 0.7)
    raw, p = np.vstack([pos, mix]), np.arange(8000) < 2000

    class Table:
        def __init__(self, use):
            self.use = use
    old = Q._sums
    Q._sums = lambda t, width, part: part(raw[t.use], p[t.use])
    try:
        even = np.arange(8000) % 2 == 0
        w = Q.fit(Table(even), Q.PRIOR_START)
        prior = Q.estimate_prior(Table(~even), w)
        w = Q.fit(Table(np.ones(8000, bool)), prior, w)
    finally:
        Q._sums = old
    assert abs(prior - 0.7) < 0.05
    s = Q._score(raw, w)
    assert ((s >= 0.5) == (raw[:, 0] > 0.5)).mean() > 0.99


def test_edge_rows(spark):
    rows = [(i, "good words in a row " * (1 + i % 5), 1) for i in range(40)] + [(100 + i, "!! ## " * 20, 1) for i in range(10)]
    rows += [(200, None, 1), (201, "", 1), (None, "x", 1), (202, "w " * 100000, 1), (202, "w " * 100000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100, 0), (0, 1), (None, 1), (1, None)], "doc_id bigint, quality int")
    got = Q.quality_scores(docs, labels)
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    same = {r.doc_id: r.score for r in out}
    assert same[200] == same[201] and next(r for r in out if r.doc_id is None).held_out is False
    none = Q.quality_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    kept = Q.keep_good(docs, labels)
    want = sorted(str(r.doc_id) for r in out if r.predicted)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == want


def plain_minimum(raw, pos, prior):
    """The same risk on one machine, to its minimum by damped Newton steps; also the estimate of its negative part."""
    x, w = Q.design(raw), np.zeros(Q.DIM)
    p, u = x[pos], x[~pos]
    ridge = Q.RIDGE + 1 / len(p)

    def risk(w):
        soft = lambda z: np.logaddexp(0, z)
        return prior * soft(-(p @ w)).mean() + soft(u @ w).mean() - prior * soft(p @ w).mean() + ridge / 2 * w @ w

    for _ in range(200):
        s = 1 / (1 + np.exp(-(u @ w)))
        g = u.T @ s / len(u) - prior * p.mean(axis=0) + ridge * w
        step = np.linalg.solve((u * (s * (1 - s))[:, None]).T @ u / len(u) + ridge * np.eye(Q.DIM), g)
        t = 1.0
        while risk(w - t * step) > risk(w) - 1e-4 * t * (g @ step) and t > 1e-8:
            t /= 2
        w = w - t * step
        if np.abs(g).max() < 1e-12:
            break
    return w, np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()


def test_same_weights_and_prior_as_on_one_machine(spark):
    import zlib

    import xxhash
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    learned = {r.doc_id: r.quality for r in labels if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    used = [d for d in docs if learned.get(d.doc_id, 1) == 1]       # no training negative is ever seen
    x32 = [Q.statistics((d.text or "").encode()) for d in used]
    raw, pos = np.array(x32, np.float64), np.array([d.doc_id in learned for d in used])
    half = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=42) % 2 for x in x32])
    first, negative = plain_minimum(raw[half == 0], pos[half == 0], Q.PRIOR_START)
    assert negative > 0             # the risk's non-negative part is not at its bound here
    # the least bound over all thresholds of the other half, one by one
    score, p = Q._score(raw[half == 1], first), pos[half == 1]
    n_p, n_u = p.sum(), (~p).sum()
    best = min((((~p & (score >= t)).sum() / n_u + Q.SLACK * (n_p ** -0.5 + n_u ** -0.5)) / (p & (score >= t)).mean() * p.mean(), -t)
               for t in np.arange(Q.PRIOR_BINS) / Q.PRIOR_BINS if (p & (score >= t)).any())
    t = -best[1]
    prior = ((~p & (score >= t)).sum() / n_u) / ((p & (score >= t)).sum() / n_p)
    got = Q.labelled_statistics(spark.read.parquet(f"{sf}/documents.parquet"), *Q._training(spark.read.parquet(f"{sf}/labels.parquet")), "text", "doc_id")
    w, ours = Q.train(got.cache())
    assert abs(ours - prior) < 0.01
    want, _ = plain_minimum(raw, pos, ours)
    assert np.abs(w - want).max() < 2e-3 and np.abs(Q._score(raw, w) - Q._score(raw, want)).max() < 1e-4

"""Quality classifier by positive-unlabelled learning.

Trusted positives (training rows labelled good) and unlabelled web text (every
document without a training label) are all the classifier sees; labelled
negatives are never used. It minimises the non-negative risk
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` with the logistic loss over
statistics of the whole text, by Newton passes over all rows: each task sums
its gradient and curvature, sums meet in two levels, and only d + d*d numbers
reach the driver. The class prior pi is estimated out of sample: a first
fit sees one half of the rows, and on the other half, at the score threshold
with the best bound, pi is the share of unlabelled rows above it over the
share of positives above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelspark.operators.aggregates import block_partials, collect_block_sum
from kernelspark.session import ship_package

from .common import drop_shared, shared_table

#: Character groups counted as shares of the bytes that are not white space.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?:;", b"#", b"*",
          b"$", b"%", b"&", b"|", b"<>=+/\\~^_@[]{}", b"'\"()-", bytes(range(128, 256)))
_GROUP = np.zeros((256, len(GROUPS)))
for _j, _g in enumerate(GROUPS):
    _GROUP[list(_g), _j] = 1
_SPACE = [9, 10, 11, 12, 13, 32]
#: Each share enters as min(share / knot, 1) for these knots: a piecewise linear response.
KNOTS = (0.005, 0.02, 0.08, 0.3, 1.0)
N_RAW = len(GROUPS) + 7
DIM = N_RAW * len(KNOTS) + 1
RIDGE, PASSES, TOLERANCE = 1e-3, 12, 1e-4
PRIOR_BINS, PRIOR_START = 1000, 0.5
#: Sampling error of a share or mean over n rows, times sqrt(n): holds for all thresholds with probability 0.9.
SLACK = 1.36


def statistics(text: bytes) -> np.ndarray:
    """N_RAW numbers in [0, 1] of a whole text: character shares, repetition
    of words, pairs and lines, word lengths, length. Empty text: zeros."""
    out = np.zeros(N_RAW, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(1, len(text) - int(counts[_SPACE].sum()))
    g = len(GROUPS)
    out[:g] = counts @ _GROUP / solid
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[g:] = (1 - len(set(words)) / n, 1 - pairs / (n - 1) if n > 1 else 0, 1 - len(set(lines)) / len(lines),
               sum(map(bytes.__eq__, words, words[1:])) / n, min(1, solid / n / 20), min(1, np.log1p(n) / 12),
               max(0, 1 - n / 60))
    return out


def design(raw: np.ndarray) -> np.ndarray:
    """Rows of statistics to rows of the linear model, the bias last."""
    x = np.minimum(raw[:, :, None] / np.array(KNOTS), 1).reshape(len(raw), -1)
    return np.hstack([x, np.ones((len(raw), 1))])


def _score(raw: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(design(raw) @ w, -30, 30))), 6)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_RAW).astype(np.float64)


def _sums(table: DataFrame, width: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(raw statistics, is positive)``: a block per
    task, added as blocks."""
    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        total += part(_rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool))

    used = table.filter("role IS NOT NULL").select("x", (F.col("role") == 1).alias("p"))
    return collect_block_sum(block_partials(used, width, add), width)


def _pass(w: np.ndarray):
    """Counts, loss sums, gradient sums and curvature of one Newton pass."""
    d = DIM

    def part(raw: np.ndarray, pos: np.ndarray) -> np.ndarray:
        x = design(raw)
        f = x @ w
        soft = np.logaddexp(0, f)           # loss of calling a row negative
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        u = ~pos
        xu = x[u]
        return np.concatenate([
            [pos.sum(), u.sum(), soft[pos].sum(), soft[u].sum(), (soft[pos] - f[pos]).sum()],
            x[pos].sum(axis=0), (s[pos, None] * x[pos]).sum(axis=0), (s[u, None] * xu).sum(axis=0),
            ((s[u] * (1 - s[u]))[:, None] * xu).T.dot(xu).ravel()])
    return part, 5 + 3 * d + d * d


def fit(table: DataFrame, prior: float, w: np.ndarray | None = None) -> np.ndarray:
    """Newton passes on the non-negative risk for a given prior."""
    d = DIM
    w = np.zeros(d) if w is None else w
    best, best_risk, step = w, np.inf, None
    for _ in range(PASSES):
        part, width = _pass(w)
        t = _sums(table, width, part)
        n_p, n_u = t[0], t[1]
        if not n_p or not n_u:
            return np.zeros(d)
        gp, gps, gus = t[5:5 + d] / n_p, t[5 + d:5 + 2 * d] / n_p, t[5 + 2 * d:5 + 3 * d] / n_u
        curve = t[5 + 3 * d:].reshape(d, d) / n_u
        negative = t[3] / n_u - prior * t[2] / n_p       # R_u(-) - pi R_p(-)
        ridge = RIDGE + 1 / n_p
        # the true value is not negative; below zero by more than sampling error is overfitting
        floor = -SLACK * (n_p ** -0.5 + n_u ** -0.5) * t[3] / n_u
        risk = prior * t[4] / n_p + max(0.0, negative) + ridge / 2 * w @ w
        if step is not None and (risk > best_risk + 1e-9 or negative < floor):     # back half the step
            step = step / 2
            w = best - step
            continue
        best, best_risk = w, risk
        g = prior * (gps - gp) + gus - prior * gps + ridge * w      # of pi R_p(+) + R_u(-) - pi R_p(-)
        step = np.linalg.solve(curve + ridge * np.eye(d), g)
        w = w - step
        if np.abs(step).max() < TOLERANCE:
            best = w
            break
    return best


def estimate_prior(table: DataFrame, w: np.ndarray) -> float:
    """min over thresholds of (share of U above + slack) / (share of P above),
    the ratio taken at the threshold where the bound is least."""
    def part(raw: np.ndarray, pos: np.ndarray) -> np.ndarray:
        k = np.minimum((_score(raw, w) * PRIOR_BINS).astype(int), PRIOR_BINS - 1)
        return np.concatenate([np.bincount(k[pos], minlength=PRIOR_BINS), np.bincount(k[~pos], minlength=PRIOR_BINS)])
    t = _sums(table, 2 * PRIOR_BINS, part)
    p, u = t[:PRIOR_BINS][::-1].cumsum(), t[PRIOR_BINS:][::-1].cumsum()
    if not p[-1] or not u[-1]:
        return PRIOR_START
    qp, qu = p / p[-1], u / u[-1]
    slack = SLACK * (p[-1] ** -0.5 + u[-1] ** -0.5)
    bound = np.where(qp > 0, (qu + slack) / np.maximum(qp, 1e-12), np.inf)
    k = int(bound.argmin())
    return float(np.clip(qu[k] / qp[k], 0.01, 0.99))


def labelled_statistics(docs: DataFrame, positives: DataFrame, known: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, x (statistics), role: 1 trusted positive, 0 unlabelled, null
    for rows that a training label covers but not as a positive."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t or b"").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])

    typ = docs.schema[doc_id].dataType.simpleString()
    x = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(each, f"doc_id {typ}, x binary")
    role = (known.select("doc_id").distinct().join(positives.select("doc_id", F.lit(1).alias("_p")).distinct(), "doc_id", "left")
            .select("doc_id", F.coalesce("_p", F.lit(-1)).alias("_r")))
    return x.join(role, "doc_id", "left").select(
        "doc_id", "x", F.when(F.col("_r") == 1, 1).when(F.col("_r").isNull(), 0).alias("role"))


def train(table: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, estimated prior) from ``labelled_statistics``."""
    half = F.pmod(F.xxhash64("x"), F.lit(2))      # by content: copies stay together
    first = fit(table.filter(half == 0), PRIOR_START)
    prior = estimate_prior(table.filter(half == 1), first)
    return fit(table, prior, first), prior


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _training(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    return known.filter("quality = 1").select("doc_id"), known.select("doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, prior.

    Labels count only where ``crc32(doc_id) % 3 <> 1``; rows with a null id
    or label are ignored, repeated label rows count once (a positive one
    wins). Null texts count as empty and get the score of an empty text; a
    null id is never held out and counts as unlabelled. Without positives or
    without unlabelled text every score is 0.5. Empty table: empty result.
    Texts are read whole, very long ones one at a time; equal texts have
    equal scores, and a score of exactly 0.5 is predicted good. Other columns,
    also ones named like the results, are left aside.
    """
    ship_package(docs.sparkSession)
    table = shared_table(labelled_statistics(docs, *_training(labels), text, doc_id), "quality")
    w, prior = train(table)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(_score(np.frombuffer(b"".join(x), np.float32).reshape(-1, N_RAW).astype(np.float64), w))

    scored = table.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("x").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("prior"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good, all columns
    unchanged; trained on these ``docs`` with the training labels."""
    ship_package(docs.sparkSession)
    table = shared_table(labelled_statistics(docs, *_training(labels), text, doc_id), "quality")
    w, _ = train(table)
    drop_shared(table)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series([float(_score(statistics((x or "").encode())[None].astype(np.float64), w)[0]) for x in t])

    return docs.filter(score(F.col(text)) >= 0.5)

"""Periodic runs of words: maximal stretches that repeat with a period.

Every run holds Lyndon roots, under one of the two orders of the alphabet as
the longest Lyndon words that start at their places. The first phase of
Baier's suffix sorter, which only groups suffixes, ends with exactly those
words: it is run under both orders, neighbouring equal roots are found by
their groups and extended to both sides by longest common extensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelspark.session import ship_package

from .common import WORD, free_name

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Each GRAM-word gram of a run occurs twice in it: of L >= max(24, 3q) words at
#: most the places within q of both ends escape, and 2q + 8 <= L unless q < 8.
GRAM = 8


def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """(group, length) for each place: the longest Lyndon word that starts
    there, as the number of its group (equal words, equal groups) and its
    length. The end counts as less than every word.

    Groups of suffixes are taken from the greatest down. The last place to
    the left of a member that lies in a lower group gets the group's word
    appended to its own, as often as members point to it, and forms a new
    group right above its old one.
    """
    n = len(ranks)
    number = {r: g for g, r in enumerate(sorted(set(ranks)))}
    group = [number[r] for r in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1][:len(members)]
    left = list(range(n + 1))           # place i is number i + 1; 0 lies before the text
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        for i in mine:
            left[i + 1] = i             # done: look further left
        hits: dict[int, int] = {}
        for i in mine:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                hits[j - 1] = hits.get(j - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, count in hits.items():
            moves.setdefault((count, group[j]), []).append(j)
        for count, old in sorted(moves, reverse=True):
            new, up = len(members), above[old]
            members.append(moves[count, old])
            length.append(length[old] + count * length[g])
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new             # up is never -1: g itself lies above
            for j in members[new]:
                group[j] = new
        members[g] = []
        g = below[g]
    return group, [length[g] for g in group]


def common_extension(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal entries that the two begin with, found in doubling steps."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(at + step, n)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 2 * step
    return n


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    n, found = len(ids), set()
    for order in (ids, -ids):
        group, length = (np.array(x, np.int64) for x in lyndon_groups(order.tolist()))
        nxt = np.arange(n) + length
        again = (nxt < n) & (group[np.minimum(nxt, n - 1)] == group)
        before = np.arange(n) - length
        head = again & ~((before >= 0) & (group[np.maximum(before, 0)] == group))
        for i in np.flatnonzero(head).tolist():
            p = int(length[i])
            start = i - common_extension(ids[:i][::-1], ids[:i + p][::-1])
            end = i + p + common_extension(ids[i:], ids[i + p:])
            if end - start >= max(MIN_WORDS, MIN_PERIODS * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


_MULTIPLIERS = np.random.default_rng(12).integers(1, 1 << 62, GRAM).astype(np.uint64) | np.uint64(1)


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts that can hold runs: covered by grams that
    occur twice. Hash collisions only add to them."""
    n = len(ids)
    if n < MIN_WORDS:
        return
    u = ids.astype(np.uint64)
    h = sum(u[k:n - GRAM + 1 + k] * _MULTIPLIERS[k] for k in range(GRAM))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return
    edge = np.zeros(n + 1, np.int64)
    for places in (order[1:][same], order[:-1][same]):
        np.add.at(edge, places, 1)
        np.add.at(edge, places + GRAM, -1)
    border = np.diff(np.concatenate([[0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]]))
    for s, e in zip(np.flatnonzero(border == 1).tolist(), np.flatnonzero(border == -1).tolist()):
        if e - s >= MIN_WORDS:
            yield s, e


def text_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words."""
    if len(words) < MIN_WORDS:
        return []
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    return [(s + a, n, p) for s, e in _stretches(ids) for a, n, p in word_runs(ids[s:e])]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats: each run's first period stays."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [w for w, x in zip(words, np.cumsum(gone).tolist()) if not x]


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def repeated_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with three columns: ``runs`` (array of
    start, length, period in words, by start and period), ``strongest`` (the
    run with the greatest length / period, the first of equals, else null)
    and ``collapsed`` (the words outside the repeated periods, joined by one
    space). No shuffle; a row needs memory for its own words.

    Null and empty texts have no runs and collapse to the empty text. Texts
    are read whole, very long ones too (time grows as n log n). Repeated rows
    give equal results; an empty table gives an empty result; columns of the
    new names are replaced.
    """
    ship_package(docs.sparkSession)
    new = ["runs", "strongest", "collapsed"]
    rest = [c for c in docs.columns if c.lower() not in [text.lower(), *new]]
    t = free_name(docs, "_text")
    kept = docs.select(*rest, F.col(text).cast("binary").alias(t))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(c, pa.int64()) for c in RUN.names])
        for b in batches:
            rows, best, out = [], [], []
            for x in b.column(len(rest)):
                words = (x.as_py() or b"").split()      # at [\x20\x09-\x0D]
                runs = text_runs(words)
                rows.append([dict(zip(RUN.names, r)) for r in runs])
                best.append(max(rows[-1], key=lambda r: Fraction(r["length"], r["period"]), default=None))
                out.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(rows, pa.list_(struct)), pa.array(best, struct),
                 pa.array(out, pa.binary()).cast(pa.string())], [*rest, *new])

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("runs", T.ArrayType(RUN)),
                           T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
    return kept.mapInArrow(each, schema)


def looped(docs: DataFrame) -> Column:
    """The text with periods planted by the hash of the id: where
    crc32(doc_id) ends in 0, the words from a place on repeat a short piece.
    Texts of rows with a null id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    piece = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    whole = F.concat(F.slice(words, F.lit(1), a.cast("int")),
                     F.flatten(F.array_repeat(piece, F.ceil((n - a) / p).cast("int"))))
    return F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.concat_ws(" ", F.slice(whole, F.lit(1), n.cast("int")))) \
        .otherwise(F.col("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the strongest run (start, length, period,
    exponent_milli; nulls without a run), runs_sha256 and collapsed_sha256 of
    its text with planted periods; edge rows as in ``repeated_runs``."""
    found = repeated_runs(docs.select("doc_id", looped(docs).alias("text")))
    best = F.col("strongest")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000L * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

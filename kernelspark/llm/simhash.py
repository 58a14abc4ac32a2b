"""SimHash near-dedup with a covering code as anchor points.

A 64-bit fingerprint is two halves of 32 bits. Fingerprints at most ``MAX_BITS``
(3) bits apart have a half at most 1 bit apart. For each half the anchors are
the words of the Hamming(31, 26) code on 31 bits, with the last bit free: a
perfect code, so every half lies within covering radius 1 of exactly one
anchor, its home. A fingerprint is replicated to every anchor within radius
plus threshold (2) of its half: at most 17 per half, found from the syndrome.
If x and y have a half at most 1 bit apart, y is at x's home; so comparing, per
anchor, what is at home there with what was replicated there finds every pair.

Distinct fingerprints are compared, not documents. An anchor emits a spanning
set of links (each linked fingerprint with one representative), never all
pairs; components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.session import ship_package

from .common import free_name, shared_table
from .components import connected_components

SHINGLE = 3
MAX_BITS = 3
_RADIUS, _NEAR = 1, 1        # covering radius of the code; bits in which the nearer halves may differ


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash over XXH64 (seed 42) of the k-word shingles, repeats
    included; fewer words: the whole sequence; none: zero."""
    words = text.lower().split()        # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(k, len(words))
    first = (ends - size)[:len(words) - k + 1].tolist()
    last = ends[k - 1:].tolist()
    h = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, 1 << 16):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t or b"") for t in texts], "<u8").view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])


# By syndrome: the masks that lead from a 31-bit word to the code words 2 bits away.
_PAIRS = np.zeros((32, 15), np.int64)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i != _s and i < i ^ _s]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit halves: (index into ``half``, anchor, is it the home)."""
    word, top = half & 0x7FFFFFFF, half & 0x80000000
    s = np.zeros_like(half)
    for i in range(31):
        s ^= ((word >> i) & 1) * (i + 1)
    own = word ^ np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0)
    i = np.arange(len(half))
    off = np.flatnonzero(s)             # words of the code have no other code word within 2 bits
    far = (word[off, None] ^ _PAIRS[s[off]]) | top[off, None]
    index = np.concatenate([i, i, np.repeat(off, 15)])
    return (index, np.concatenate([own | top, own | (top ^ 0x80000000), far.ravel()]),
            np.concatenate([np.ones(len(half), bool), np.zeros(len(half) + far.size, bool)]))


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for part in (0, 1):
            i, a, home = anchors((fp >> (32 * part)) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a | (part << 32)), pa.array(fp[i]), pa.array(home)], ["anchor", "fp", "home"])


def _spanning_links(homes: np.ndarray, others: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that span the components which the
    pairs home-home and home-other within ``max_bits`` form. The pairs are
    compared in blocks and again until no label changes; none is stored."""
    every = np.concatenate([homes, others])
    label = np.arange(len(homes))
    none = len(homes)
    step = max(1, (1 << 22) // len(homes))
    while True:
        before, own = label.copy(), np.full(len(every), none)
        for at in range(0, len(every), step):
            near = np.bitwise_count(every[at:at + step, None] ^ homes[None, :]) <= max_bits
            low = np.where(near, label[None, :], none).min(axis=1)
            own[at:at + step] = low
            label = np.minimum(label, np.where(near, low[:, None], none).min(axis=0))
        label = label[label]
        if np.array_equal(label, before):
            break
    linked = own < none
    linked[:len(homes)] &= own[:len(homes)] != np.arange(len(homes))
    return every[linked], homes[own[linked]]


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(cols[0]):
                continue
            if held and cols[0][-1] == held[0][0][0]:      # still the same anchor: wait for its end
                held.append(cols)
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held, cols)) if held else cols
            cut = np.searchsorted(whole[0], whole[0][-1])
            yield links(*(x[:cut] for x in whole))
            held = [tuple(x[cut:] for x in whole)]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        if len(anchor):
            fp = fp.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(first, len(anchor)))
            worth = (np.add.reduceat(home.astype(np.int64), first) > 0) & (size > 1)
            for s, n in zip(first[worth].tolist(), size[worth].tolist()):
                f, h = fp[s:s + n], home[s:s + n]
                a, b = _spanning_links(np.sort(f[h]), f[~h], max_bits)
                out_a.append(a)
                out_b.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links of at most
    ``max_bits`` <= 3 bits).

    Null and empty texts have fingerprint zero and are linked like any
    other. Null ids are ignored when the smallest id is sought; a component
    of null ids alone has component_id null. Rows that repeat an id fall
    into the components of each of their texts. Empty table: empty result.
    All shingles of a very long text count. A bit set in exactly half of the
    hashes is 0; equal distances do not matter, since every link counts.
    Columns other than id and text are left aside.
    """
    if not 0 <= max_bits <= 2 * _NEAR + 1:
        raise ValueError(f"the anchors find links of at most {2 * _NEAR + 1} bits")
    ship_package(docs.sparkSession)
    typ = docs.schema[doc_id].dataType.simpleString()
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _fingerprints, f"doc_id {typ}, fp bigint")
    marked = shared_table(marked, "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint, home boolean")
    links = spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(max_bits), "a bigint, b bigint")
    roots = connected_components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all
    columns unchanged. Rows without an id stay; rows that repeat an id go
    together. Columns may have any names; an empty table stays empty."""
    name = free_name(docs, "gone")
    gone = (near_duplicates(docs, text, doc_id).filter("doc_id != component_id")
            .select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")

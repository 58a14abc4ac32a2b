"""op5 against brute force over all pairs."""

import random

import numpy as np
import xxhash

from kernelspark.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits=3):
    low = list(range(len(ids)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                low[max(a, b)] = min(a, b)
    small = {}
    for i, d in enumerate(ids):
        small[find(i)] = min(small.get(find(i), d), d)
    return {d: small[find(i)] for i, d in enumerate(ids)}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps)}
    for r in got:
        assert r.fingerprint == by[r.doc_id] and r.component_id == want[r.doc_id]


def test_anchor_links_find_every_near_pair(spark):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    for f in fps[:200]:         # neighbours at 1 to 5 bits, and chains of them
        for k in range(1, 6):
            for b in rnd.sample(range(64), k):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint").repartition(5)
    links = df.mapInArrow(simhash._replicate, "anchor bigint, fp bigint, home boolean").repartition(7, "anchor") \
        .sortWithinPartitions("anchor").mapInArrow(simhash._compare(3), "a bigint, b bigint")
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = plain_components(signed, fps)
    for s in signed:
        assert roots.get(s, s) == want[s]


def test_anchors_cover(spark):
    half = np.random.default_rng(1).integers(0, 1 << 32, 2000)
    i, a, home = simhash.anchors(half)
    assert (np.bitwise_count(half[i] ^ a) <= 2).all() and (np.bitwise_count(half[i] ^ a)[home] <= 1).all()
    assert home.sum() == len(half) and np.bincount(i).max() == 17


def test_edge_rows(spark):
    long = "word " * 60000
    rows = [(0, "A b c d", 1), (1, "a  B\tc\nd", 2), (2, None, 3), (3, "", 4), (4, " \n", 5), (5, "one", 6),
            (None, "one", 7), (6, long, 8), (7, long, 9), (7, long, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp bigint")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.component_id, r.fingerprint)
                  for r in simhash.near_duplicates(df).collect()))
    assert [(d, c) for d, c, _ in got] == [(-1, 5), (0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6), (7, 6), (7, 6)]
    assert got[3][2] == "0" * 16
    kept = simhash.drop_near_copies(df).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, 0, 2, 5, 6] and kept[0].__fields__ == ["doc_id", "text", "fp"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0

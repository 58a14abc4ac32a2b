"""op9: the chain against a quadratic search, planted passages, edge rows."""

import random

import numpy as np
import pyarrow as pa

from kernelspark.llm import passages as P


def plain_best(segments):
    """Best chain score by looking at every pair."""
    f = {}
    for i in sorted(range(len(segments)), key=lambda i: segments[i][1]):
        x, y, w = segments[i]
        f[i] = float(w)
        for j in f:
            a, b, n = segments[j]
            if j != i and a + n <= x and b + n <= y and max(x - a - n, y - b - n) <= P.MAX_GAP:
                f[i] = max(f[i], f[j] + w - P.GAP_COST * (x - a - n + y - b - n))
    return max(f.values())


def score(segments, path):
    s = segments[path[0]][2]
    for i, j in zip(path, path[1:]):
        (a, b, n), (x, y, w) = segments[i], segments[j]
        assert a + n <= x and b + n <= y
        s += w - P.GAP_COST * (x - a - n + y - b - n)
    return s


def test_chain_finds_the_best():
    r = random.Random(2)
    for _ in range(300):
        segments = sorted({(r.randrange(40), r.randrange(40), r.randrange(7, 12)) for _ in range(r.randrange(1, 9))}, key=lambda s: s[1])
        paths = P.chain(segments)
        assert sorted(i for p in paths for i in p) == list(range(len(segments)))
        assert abs(max(score(segments, p) for p in paths) - plain_best(segments)) < 1e-9


def test_prefix_maxima():
    r, tree, put = random.Random(1), P.PrefixMax(50), {}
    for k in range(200):
        i, v = r.randrange(50), r.random()
        tree.put(i, v, k)
        put[i] = max(put.get(i, (-1, 0)), (v, k))
        n = r.randrange(51)
        want = max((x for j, x in put.items() if j < n), default=None)
        assert tree.best(n)[1] == (want[1] if want else -1)


def test_matching_words():
    a = list(range(20))
    assert P.matching_words(a, a) == 20 and P.matching_words(a, a[:7] + [99] + a[8:]) == 19
    assert P.matching_words(a, a[:5] + a[6:]) == 19 and P.matching_words(a, [77] + a) == 20
    assert P.matching_words([], a) == 0 and P.matching_words([1, 2], [3]) == 0


def test_planted_passages(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    prose = lambda n: [word() for _ in range(n)]
    long, fuzzy, short = prose(120), prose(100), prose(30)
    rows, want = [], {}
    for i in range(60):
        rows.append([i, prose(150 + i), 0])
    for i in (3, 9, 12, 40):                # an exact passage in four documents
        at = r.randrange(100)
        rows[i][1][at:at] = long
        want[i] = (at, 120)
    for k, i in enumerate((5, 20, 33)):     # a passage with a changed, a missing and an added word
        part = list(fuzzy)
        if k:
            part[30], part[62:63] = word(), []
            part.insert(85, word())
        rows[i][1][50:50] = part
        want[i] = (50, len(part))
    for i in (50, 51, 52):                  # too short to count
        rows[i][1][10:10] = short
    rows += [[70, list(rows[30][1]), 0], [71, None, 0], [72, [], 0], [73, prose(5), 0], [None, list(rows[30][1]), 0], [74, ["same"] * 50000, 0],
             [75, ["same"] * 40000, 0], [70, list(rows[30][1]), 0]]
    df = spark.createDataFrame([(i, None if t is None else "  ".join(t).title(), 0) for i, t, _ in rows],
                               "doc_id bigint, text string, start int").repartition(4)
    got = P.shared_passages(df).collect()
    found = {}
    for g in got:
        assert g.doc_id != g.other_id and g.passage_words >= P.MIN_WORDS and g.identity >= P.MIN_IDENTITY
        found.setdefault(g.doc_id, []).append(g)
    first = {3, 5}
    for i, (at, n) in want.items():
        if i in first:
            assert i not in found
            continue
        g = max(found[i], key=lambda g: g.end - g.start)
        assert g.other_id == (3 if n == 120 else 5) and abs(g.start - at) <= 2 and abs(g.end - at - n) <= 2
        assert g.identity == 1 if n == 120 else g.identity >= 0.95
    assert set(found) == set(want) - first | {70, 75} or set(found) == set(want) - first | {70}
    whole = found[70][0]
    assert (whole.start, whole.end, whole.other_id, whole.identity) == (0, len(rows[30][1]), 30, 1.0)
    assert P.shared_passages(df.limit(0)).count() == 0


def test_parts_from_different_documents_count_together(spark):
    r = random.Random(9)
    p = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(70)]
    rows = [(1, " ".join(p[:36])), (2, " ".join(p[35:])), (3, " ".join(p))]
    got = P.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((g.doc_id, g.other_id) for g in got) == [(3, 1), (3, 2)] and {g.passage_words for g in got} == {70}


def vocabulary(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def pairs(spark, rows):
    got = P.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")).collect()
    return sorted(got, key=lambda g: (g.doc_id, g.start))


def test_edits_spread_out(spark):
    r = random.Random(11)
    cases = [(n, step, at) for n, step in ((50, 5), (60, 5), (60, 8), (60, 10), (100, 8), (200, 8)) for at in range(step)]
    rows = []
    for k, (n, step, at) in enumerate(cases):
        p = vocabulary(r, n)
        changed = [vocabulary(r, 1)[0] if i % step == at else w for i, w in enumerate(p)]
        rows += [(2 * k, vocabulary(r, 60) + p + vocabulary(r, 60)), (2 * k + 1, vocabulary(r, 55) + changed + vocabulary(r, 70))]
    got = {g.doc_id: g for g in pairs(spark, rows)}
    # a changed word at an end of the passage leaves it a word shorter
    want = {2 * k + 1 for k, (n, step, at) in enumerate(cases) if n > 50 or 0 < at < step - 1}
    assert want <= set(got) <= {2 * k + 1 for k in range(len(cases))}
    assert all(g.other_id == g.doc_id - 1 and 0.8 <= g.identity < 1 for g in got.values())


def test_chain_cut_where_it_does_not_agree(spark):
    r = random.Random(12)
    p, q = vocabulary(r, 100), vocabulary(r, 24)
    got = pairs(spark, [(1, p + vocabulary(r, 40) + q), (2, p + vocabulary(r, 40) + q)])
    assert [(g.doc_id, g.start, g.end, g.identity) for g in got] == [(2, 0, 100, 1.0)]


def test_chain_past_a_long_match():
    segments = [(0, 0, 300), (345, 345, 13), (360, 360, 13), (375, 375, 13), (390, 390, 13)]
    assert sorted(P.chain(segments)) == [[0], [1, 2, 3, 4]]
    r = random.Random(3)
    for _ in range(300):
        segments = sorted({(r.randrange(400), r.randrange(400), r.choice((7, 9, 60, 150))) for _ in range(r.randrange(2, 12))}, key=lambda s: s[1])
        assert abs(max(score(segments, p) for p in P.chain(segments)) - plain_best(segments)) < 1e-9


def test_passage_behind_a_long_match(spark):
    r = random.Random(13)
    p, q = vocabulary(r, 300), vocabulary(r, 58)
    changed = [vocabulary(r, 1)[0] if i in (13, 14, 28, 29, 43, 44) else w for i, w in enumerate(q)]
    got = pairs(spark, [(1, p + vocabulary(r, 45) + q), (2, p + vocabulary(r, 45) + changed)])
    assert [(g.doc_id, g.start, g.end) for g in got] == [(2, 0, 300), (2, 345, 403)]


def test_short_parts_from_different_documents(spark):
    r = random.Random(14)
    for sizes in ((18, 18, 18), (19, 19, 19), (10, 14, 12, 19)):
        parts = [vocabulary(r, n) for n in sizes]
        whole = sum(parts, [])
        rows = [*enumerate(parts), (10, vocabulary(r, 30) + whole + vocabulary(r, 30)), (11, vocabulary(r, 41) + whole + vocabulary(r, 9))]
        got = pairs(spark, rows)
        for doc, at in ((10, 30), (11, 41)):
            mine = [g for g in got if g.doc_id == doc]
            assert {g.passage_words for g in mine} == {sum(sizes)} and {g.other_id for g in mine} >= set(range(len(sizes)))
            assert (mine[0].start, max(g.end for g in mine)) == (at, at + sum(sizes))
        assert {g.doc_id for g in got} == {10, 11}


def test_every_copy_in_a_document(spark):
    r = random.Random(15)
    p = vocabulary(r, 60)
    early = p[20:30]            # a phrase of the passage that stands earlier in both documents
    got = pairs(spark, [(1, early + vocabulary(r, 20) + p), (2, early + vocabulary(r, 30) + p + vocabulary(r, 40) + p), (3, ["a", "b"] * 300), (4, ["a", "b"] * 400)])
    assert [(g.doc_id, g.start, g.end, g.other_start, g.identity) for g in got if g.doc_id == 2 and g.end - g.start >= 50] == [
        (2, 40, 100, 30, 1.0), (2, 140, 200, 30, 1.0)]
    assert (4, 0, 600) in [(g.doc_id, g.start, g.end) for g in got]


def local_alignment(a, b):
    """Best stretch of two word lists under +1 a match, -3.5 an edit: (score, a start, a end, b start, b end)."""
    best = (0, 0, 0, 0, 0)
    row = [(0, 0, j) for j in range(len(b) + 1)]        # score, where it began
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (0, i, 0)
        for j, y in enumerate(b, 1):
            ways = [(0, i, j), (row[j][0] - 3.5, *row[j][1:]), (row[j - 1][0] - 3.5, *row[j - 1][1:]),
                    (diagonal[0] + (1 if x == y else -3.5), *diagonal[1:])]
            diagonal, row[j] = row[j], max(ways, key=lambda w: w[0])
            if row[j][0] > best[0]:
                best = (row[j][0], row[j][1], i, row[j][2], j)
    return best


def aligned_words(a, b):
    """Most matching words of a global alignment with fewest edits."""
    row = [(-j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (-i, 0)
        for j, y in enumerate(b, 1):
            ways = [(diagonal[0] - (x != y), diagonal[1] + (x == y)), (row[j][0] - 1, row[j][1]), (row[j - 1][0] - 1, row[j - 1][1])]
            diagonal, row[j] = row[j], max(ways)
    return row[-1][1]


def test_whole_query_against_all_pairs(spark):
    """Every pair of documents is aligned: long shared stretches are found, and every row holds by itself."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs = [[word() for _ in range(r.randrange(20, 160))] for _ in range(24)]
    for _ in range(26):
        src, at = r.randrange(12), r.randrange(len(docs) // 2, len(docs))
        n = r.randrange(30, 110)
        lo = r.randrange(max(1, len(docs[src]) - n + 1))
        piece, share = docs[src][lo:lo + n], r.choice((0, 0, 0.03, 0.06, 0.1))
        piece = [w for x in piece for w in ([x] if r.random() >= share else r.choice(([word()], [], [x, word()])))]
        cut = r.randrange(len(docs[at]) + 1)
        docs[at][cut:cut] = piece
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string").repartition(5)
    rows = P.shared_passages(df).collect()
    for x in rows:
        a, b = docs[x.doc_id][x.start:x.end], docs[x.other_id][x.other_start:x.other_end]
        assert x.other_id < x.doc_id and x.passage_words >= 50
        same = aligned_words(a, b)
        assert x.matched <= same and same / max(len(a), len(b)) >= P.MIN_IDENTITY - 1e-9
    covered = {}
    for x in rows:
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    found = 0
    for d in range(len(docs)):
        for o in range(d):
            if len(set(docs[d]) & set(docs[o])) < 20:
                continue
            _, a, b, c, e = local_alignment(docs[d], docs[o])
            if min(b - a, e - c) >= 55 and aligned_words(docs[d][a:b], docs[o][c:e]) >= 0.85 * max(b - a, e - c):
                found += 1
                assert len(covered.get(d, set()) & set(range(a, b))) >= 0.9 * (b - a), (d, o, a, b)
    assert found >= 8 and len(rows) >= 8


def test_seed_step_holds_little():
    """A batch of many texts with many different words: neither all texts nor
    all words are held as Python objects."""
    import tracemalloc
    rng = np.random.default_rng(7)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 10 ** 9, 250)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], ["id", "t"])
    del texts
    tracemalloc.start()
    try:
        n = sum(len(P._unpack(x, np.int32)) for b in P._seed_blocks(4)(iter([batch])) for x in b.column(5).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 3000 * 247
    assert peak < 48 << 20


def scattered(r, first_id, passage, n):
    """Documents that each hold ``n`` words in a row of the passage, at every place, among words of their own."""
    return [(first_id + i, vocabulary(r, 20) + passage[i:i + n] + vocabulary(r, 20)) for i in range(len(passage) - n + 1)]


def test_passage_whose_seeds_are_first_elsewhere(spark):
    """Every 4-word gram of the passages stands alone in an earlier document, so no two seeds have the same first."""
    r = random.Random(31)
    p, q = vocabulary(r, 60), vocabulary(r, 60)
    fuzzy = [vocabulary(r, 1)[0] if i % 7 == 5 else w for i, w in enumerate(q)]     # runs of six words
    missing = [w for i, w in enumerate(q) if i % 10 != 4]
    rows = [*scattered(r, 0, p, 4), *scattered(r, 100, q, 4),
            (200, vocabulary(r, 30) + p + vocabulary(r, 40)), (201, vocabulary(r, 25) + p + vocabulary(r, 30)), (202, vocabulary(r, 9) + p),
            (210, vocabulary(r, 30) + q + vocabulary(r, 40)), (211, vocabulary(r, 25) + fuzzy), (212, vocabulary(r, 8) + missing)]
    got = pairs(spark, rows)
    assert {(g.doc_id, g.other_id) for g in got} == {(201, 200), (202, 200), (211, 210), (212, 210)}
    assert [(g.start, g.end, g.other_start, g.identity, g.passage_words) for g in got if g.doc_id < 203] == [(25, 85, 30, 1.0, 60), (9, 69, 30, 1.0, 60)]
    words = {g.doc_id: g for g in got}
    assert words[211].passage_words >= 57 and words[211].start == 25 and words[212].passage_words >= 50


def test_passage_whose_seeds_stand_earlier_in_its_first_document(spark):
    """The grams of the passage have their firsts in other documents and in
    scattered places of the document that holds it first."""
    r = random.Random(32)
    p = vocabulary(r, 60)
    odd = [w for i in range(1, 57, 2) for w in p[i:i + 4] + vocabulary(r, 1)]
    rows = [*scattered(r, 0, p, 4)[::2], (100, odd + vocabulary(r, 20) + p), (101, vocabulary(r, 12) + p + vocabulary(r, 5))]
    got = [g for g in pairs(spark, rows) if g.other_id == 100]
    assert [(g.doc_id, g.start, g.end, g.other_start, g.identity) for g in got if g.end - g.start > 50] == [(101, 12, 72, len(odd) + 20, 1.0)]


def test_singles_are_left_out_and_nothing_else():
    """Packed seeds come back: all that occur twice, in the same block or in another one."""
    r = np.random.default_rng(3)
    words = [f"w{x}" for x in r.integers(0, 10 ** 6, 3000)]
    texts = [" ".join(words[:1000]), " ".join(words[500:1500]), " ".join(words[2000:]), " ".join(words[1400:2100])]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 2)), pa.array(texts[i:i + 2])], ["id", "t"]) for i in (0, 2)]
    packed = [b for batch in batches for b in P._seed_blocks(1)(iter([batch]))]
    rows = [row for b in P._seed_rows(1)(iter(packed)) for row in zip(*(c.to_pylist() for c in b.columns))]
    count = {}
    for d, t in enumerate(texts):
        ws = t.split()
        for i in range(len(ws) - P.K + 1):
            count.setdefault(tuple(ws[i:i + P.K]), []).append((d, i))
    twice = sorted(z for v in count.values() if len(v) > 1 for z in v)
    assert len(twice) == 2 * (497 + 97 + 97) and set(twice) <= {(d, at >> 32) for _, d, at in rows}
    assert len(rows) < len(twice) + 20

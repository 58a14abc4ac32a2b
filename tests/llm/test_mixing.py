"""op10: budgets, edge rows, reruns. The query itself has an SQL twin."""

import pytest

from kernelspark.llm import mixing as M


def plain_targets(sizes):
    """Reshare the excess by weight until no target is above its cap."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: M.WEIGHTS[i % 3] for i, k in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total >= 3 * sizes[k]]
        if not over:
            out |= {k: left * w[k] / total for k in open_}
            break
        for k in over:
            out[k] = 3.0 * sizes[k]
        left -= sum(out[k] for k in over)
        open_ -= set(over)
    return out


def test_targets_and_budgets(spark):
    sizes = {"a": 3, "b": 1000, "c": 10, "d": 400, "é": 1, "z": 2000, None: 5, "y": 0}
    rows, i = [], 0
    for s, n in sizes.items():
        while n > 0:
            k = min(n, 1 + i % 7)
            rows.append((i, "w " * k, s, i))
            n, i = n - k, i + 1
    rows += [(i, None, "y", 1), (i + 1, "", "y", 1), (i + 1, "", "y", 1), (None, "", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").repartition(3)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    want = plain_targets(sizes)
    taken = {}
    where = {r[0]: r[2] for r in rows}
    for r in got:
        s = where[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 3 * r["size"] and r.copies <= 3
        taken[s] = taken.get(s, 0) + r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = {(r.doc_id, r.taken, r.copies) for r in M.mix(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken, r.copies) for r in got}
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.filter("size(split(trim(text), ' ')) > 0").count() >= sum(r.copies for r in got if r["size"])


def test_all_empty_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [(r.target, r.taken) for r in M.mix(df).collect()] == [(0.0, 0)] * 2
    assert M.mix(df.limit(0)).count() == 0


def test_running_total_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from kernelspark.llm.common import md5_uniform, running_total
    key, u = md5_uniform(F.lit("s"), F.col("id"))
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), key.alias("k"), u.alias("u"),
                                  (F.col("id") % 5).alias("v"))
    got = running_total(df, ["g"], "u", ["k"], F.col("v"), "at", 5000, per_bucket=40).collect()
    for g in (0, 1):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.at == at
            at += r.v


def test_the_mix_holds_each_row_as_often_as_it_says(spark):
    """Very long texts, repeated rows, clashing columns: exact copies per document, texts whole."""
    from collections import Counter
    long = "w " * 150_000
    rows = [(0, long, "a", 1, 2), (1, "x y", "b", 1, 2), (1, "x y", "b", 1, 2), (2, "z " * 40, "b", 1, 2), (3, "q " * 9, None, 1, 2)]
    rows += [(10 + i, f"n{i} " * (1 + i % 9), "abc"[i % 3], 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int, taken int").repartition(3)
    want = Counter()
    for r in M.mix(df).collect():
        want[r.doc_id] += r.copies
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter({k: n for k, n in want.items() if n})
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] and (r.copies, r.taken) == (1, 2) for r in got)

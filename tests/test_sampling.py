import hashlib

from pyspark.sql import functions as F

from kernelspark.operators import sampling as S


def _md5_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_global_rank_is_exact(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k"))
    ranked = S.global_rank(df, ["k"], "pos", num_partitions=7).collect()
    got = sorted((r["k"], r["pos"]) for r in ranked)
    assert [p for _, p in got] == list(range(5000))


def test_random_permutation_matches_md5_order(spark):
    df = spark.range(0, 300).select(F.col("id").alias("vid"), (F.col("id") % 3).alias("g"))
    perm = {r["vid"]: r["perm_pos"] for r in S.random_permutation(df, 42, ["vid"]).collect()}
    order = _md5_order(range(300), 42)
    assert [perm[i] for i in order] == list(range(300))
    by = S.random_permutation(df, 42, ["vid"], by="g").collect()
    for g in range(3):
        pos = {r["vid"]: r["perm_pos"] for r in by if r["g"] == g}
        order_g = _md5_order([i for i in range(300) if i % 3 == g], 42)
        assert [pos[i] for i in order_g] == list(range(100))


def test_train_test_split_exact_and_complementary(spark, monkeypatch):
    monkeypatch.setattr(S, "RADIX_LEAF", 50)          # force several radix levels
    df = spark.range(0, 2000).select(F.col("id").alias("vid"))
    train, test = S.train_test_split(df, 0.8, 7, ["vid"])
    tr = sorted(r["vid"] for r in train.collect())
    te = sorted(r["vid"] for r in test.collect())
    assert len(tr) == 1600 and len(te) == 400 and not set(tr) & set(te)
    assert tr == sorted(_md5_order(range(2000), 7)[:1600])


def test_sample_n_per_group_and_kth_smallest(spark):
    df = spark.range(0, 400).select(F.col("id").alias("vid"), (F.col("id") % 4).alias("g"))
    s = S.sample_n(df, 1, ["vid"], "g", F.when(F.col("g") == 0, 2).otherwise(5), 5).collect()
    for g in range(4):
        got = sorted((r["sample_pos"], r["vid"]) for r in s if r["g"] == g)
        want = _md5_order([i for i in range(400) if i % 4 == g], 1)[: 2 if g == 0 else 5]
        assert [v for _, v in got] == want
    vals = spark.createDataFrame([(float(x),) for x in [5, 3, 9, 1, 7]], "v double")
    assert S.kth_smallest(vals, "v", 2).first()["value"] == 3.0


def test_global_rank_after_shuffles_and_joins(spark):
    # the input arrives in no particular order from a shuffled semi-join
    a = spark.range(0, 4000).repartition(7).select(F.col("id").alias("k"), (F.col("id") % 13).alias("v"))
    b = spark.range(0, 4000, 3).repartition(5).select(F.col("id").alias("k"))
    df = a.join(b, "k", "left_semi")
    got = sorted((r["row_id"], r["k"]) for r in S.global_rank(df, ["k"], "row_id", 6).collect())
    assert [k for _, k in got] == list(range(0, 4000, 3))
    assert [i for i, _ in got] == list(range(len(got)))


def test_global_rank_on_dates_and_strings(spark):
    df = spark.range(0, 500).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("d"),
        F.format_string("s%04d", F.col("id")).alias("s"))
    got = S.global_rank(df, ["d", "s"], "pos", 5).collect()
    want = sorted((r["d"], r["s"]) for r in got)
    assert [p for _, p in sorted(((r["d"], r["s"]), r["pos"]) for r in got)] == list(range(500))
    assert len(want) == 500


def test_kth_values_share_their_passes(spark, monkeypatch):
    import random
    monkeypatch.setattr(S, "HISTOGRAM_BINS", 8)
    r = random.Random(4)
    values = [r.choice((0.0, 1.5, -1e300, 1e300, 7.25, r.random(), r.gauss(0, 1e-5))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "v double").repartition(4)
    ks = [0, 1, 2, 77, 150, 151, 299, 300, 301]
    want = [None if not 1 <= k <= 300 else sorted(values)[k - 1] for k in ks]
    assert S.kth_values(df, "v", ks) == want
    assert S.kth_values(df.limit(0), "v", [1]) == [None] and S.kth_values(df, "v", []) == []

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kernelspark.sources import text as TX
from kernelspark.streaming import scoring as ST


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_text_rows_labels_and_checks(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "train.txt")
    _write(p, [f" {i}.0 {i * 2}.5 {1 if i % 2 else -1} " for i in range(50)])
    rows = TX.read_labeled_rows(spark, p, 3).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(50))
    assert rows[7]["features"] == [7.0, 14.5] and rows[7]["label"] == 1.0
    lp = os.path.join(tmpdir_path, "labels.txt")
    _write(lp, [f"{1 if i % 3 else -1} extra" for i in range(50)])
    labels = TX.read_labels(spark, lp)
    assert TX.check_count(labels, 50) == 50
    with pytest.raises(ValueError):
        TX.check_count(labels, 49)
    hp = os.path.join(tmpdir_path, "test.csv")
    _write(hp, ["1.0,2.0,9.0", "3.0,4.0,9.0"])
    h = TX.read_dense_rows(spark, hp, 2, sep=",", strict=False, append_bias=True).orderBy("row_id").collect()
    assert h[1]["features"] == [3.0, 4.0, 1.0]
    bad = os.path.join(tmpdir_path, "bad.txt")
    _write(bad, ["1 2 3", "1 2"])
    with pytest.raises(Exception):
        TX.read_dense_rows(spark, bad, 3).collect()
    m = TX.rows_from_matrix(spark, [[1.0, 2.0], [3.0, 4.0]], [1, -1])
    assert m.count() == 2


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0]["correct"] + r[0]["wrong"] > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.oracle_sql().keys() >= {"scoring", "tsqr_r"} and len(E.queries()) >= 48


def test_streaming_scoring(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "stream")
    spark.createDataFrame([(0, [1.0], 1.0), (1, [-2.0], -1.0), (2, [0.5], -1.0)],
                          "row_id bigint, features array<double>, label double") \
        .write.parquet(src)
    stream = spark.readStream.schema("row_id bigint, features array<double>, label double").parquet(src)
    q = (ST.running_confusion(stream, [1.0, 0.0]).writeStream.outputMode("complete")
         .format("memory").queryName("ks_conf").start())
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM ks_conf").first()
    assert (r["correct_pos"], r["correct_neg"], r["wrong_pos"], r["wrong_neg"]) == (1, 1, 1, 0)


def test_gather_scale_block_and_partition_counts(spark):
    from kernelspark.operators import aggregates as A
    from kernelspark.operators import nystrom as NY
    from kernelspark.operators import rows as RW
    df = spark.createDataFrame([(i, [float(i), 1.0], 1.0) for i in range(10)],
                               "row_id bigint, features array<double>, label double")
    ids = spark.createDataFrame([(0, 7), (1, 2), (2, 5)], "pos int, row_id bigint")
    assert [r["row_id"] for r in RW.gather(df, ids).collect()] == [7, 2, 5]
    w = spark.createDataFrame([(i, 2.0) for i in range(10)], "row_id bigint, weight double")
    sc = {r["row_id"]: r["features"] for r in RW.scale_rows(df, w).collect()}
    assert sc[3] == [6.0, 2.0]
    with pytest.raises(Exception, match="weights for row"):      # raised by the plan itself
        RW.scale_rows(df, w.limit(5)).collect()
    blk = spark.createDataFrame([([1.0, 2.0], 2)], "u array<double>, off int")
    assert NY.block_features(blk, "u", "off", 6).first()["features"] == [0.0, 0.0, 1.0, 2.0, 0.0, 0.0]
    assert sum(r["n"] for r in A.partition_counts(df.repartition(3)).collect()) == 10


def test_history_sink(spark, tmpdir_path):
    hist = spark.createDataFrame([(1, 5.0), (2, 0.5)], "iteration int, error double")
    out = os.path.join(tmpdir_path, "hist")
    TX.write_history(hist, out)
    assert sorted(r["iteration"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_line_positions_follow_file_order(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "multi")
    os.makedirs(d)
    _write(os.path.join(d, "part-a.txt"), [f"{i}" for i in range(0, 30)])
    _write(os.path.join(d, "part-b.txt"), [f"{i}" for i in range(30, 1000)])   # larger file
    lines = TX.read_lines(spark, d).collect()
    assert sorted((r["row_id"], int(r["value"])) for r in lines) == [(i, i) for i in range(1000)]

"""Byte ranges that keep lines whole, and a history that is there whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from kernelspark.operators import joins as J
from kernelspark.operators import sampling as S
from kernelspark.sources.datasource import register


@pytest.fixture(scope="module")
def source(spark):
    register(spark)
    return spark


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text)


LINES = [f"{i} {i * 0.25} {-i}" + " " * (i % 4) for i in range(200)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_line_once_in_ranges_of_any_size(source, tmpdir_path, size, end):
    write(tmpdir_path, "a.txt", end.join(LINES[:60]).encode() + end.encode())
    write(tmpdir_path, "b.txt", end.join(["", *LINES[60:120], "", "", *LINES[120:]]).encode())     # blank lines, no end
    write(tmpdir_path, "_hidden", b"x")
    write(tmpdir_path, "empty.txt", b"")
    if size < 60:
        os.remove(f"{tmpdir_path}/b.txt")       # few enough ranges for a test
    df = source.read.format("dense_lines").option("columns", 3).option("label", "last").option("range_bytes", size).load(tmpdir_path)
    rows = df.orderBy("file", "offset").collect()
    n = 60 if size < 60 else 200
    assert [(list(r.features), r.label) for r in rows] == [([float(i), i * 0.25], float(-i)) for i in range(n)]
    offsets = {(r.file, r.offset) for r in rows}
    assert len(offsets) == n
    for f, at in offsets:
        with open(f, "rb") as raw:
            raw.seek(at)
            assert raw.readline().split()


def test_only_the_columns_asked_for(source, tmpdir_path):
    write(tmpdir_path, "a.txt", b"1,x,3\n2,y,4\n")        # x and y cannot be parsed as numbers
    df = source.read.format("dense_lines").schema("offset bigint").option("columns", 3).option("sep", ",").load(tmpdir_path)
    assert sorted(r.offset for r in df.collect()) == [0, 6]


def test_wrong_lines_raise(source, tmpdir_path):
    write(tmpdir_path, "a.txt", b"1 2 3\n1 2 3 4\n")
    read = source.read.format("dense_lines").option("columns", 3)
    with pytest.raises(Exception, match="4 values"):
        read.load(tmpdir_path).collect()
    loose = source.read.format("dense_lines").option("columns", 3).option("strict", "false").option("label", "first").load(tmpdir_path)
    assert [(list(r.features), r.label) for r in loose.collect()] == [([2.0, 3.0], 1.0)] * 2
    with pytest.raises(Exception, match="columns"):
        source.read.format("dense_lines").load(tmpdir_path).collect()


def test_history_in_two_phases(source, tmpdir_path):
    folder = f"{tmpdir_path}/h"
    steps = source.createDataFrame([(t, 1.0 / t) for t in range(1, 21)], "iteration int, error double").repartition(4)
    steps.write.format("fit_history").mode("append").save(folder)

    def read():
        return source.read.format("fit_history").load(folder)

    assert sorted(map(tuple, read().collect())) == [(t, 1.0 / t) for t in range(1, 21)]
    bad = steps.withColumn("error", F.when(F.col("iteration") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("error")))
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("fit_history").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == before and read().count() == 20
    write(folder, "part-of-a-lost-task.csv", b"99,0.0\n")       # not in the manifest
    assert read().count() == 20
    steps.limit(2).write.format("fit_history").mode("append").save(folder)
    assert read().count() == 22
    steps.limit(3).write.format("fit_history").mode("overwrite").save(folder)
    assert read().count() == 3
    with pytest.raises(Exception, match="iteration"):
        steps.withColumnRenamed("error", "x").write.format("fit_history").mode("append").save(folder)


def test_zip_raises_on_a_position_of_one_side(spark):
    a = spark.range(5).selectExpr("id AS row_id", "id * 2 AS x")
    b = spark.range(4).selectExpr("id AS row_id", "id * 3 AS y")
    with pytest.raises(Exception, match="position 4"):
        J.positional_zip(a, b).collect()
    with pytest.raises(Exception, match="position 4"):
        J.positional_zip(b, a).select("x").collect()
    assert sorted(map(tuple, J.positional_zip(a.where("row_id < 4"), b).collect())) == [(i, 2 * i, 3 * i) for i in range(4)]
    assert J.positional_zip(a, b, check_counts=False).count() == 4


def test_split_of_repeated_ids(spark, monkeypatch):
    """A bucket of one id that is above the leaf's size: counted, not ranked."""
    monkeypatch.setattr(S, "RADIX_LEAF", 10)
    df = spark.createDataFrame([(7,)] * 50 + [(i,) for i in range(30)], "row_id bigint")
    order = sorted([7] * 51 + [i for i in range(30) if i != 7], key=lambda i: __import__("hashlib").md5(f"3:{i}".encode()).hexdigest())
    for k in (1, 20, 40, 60, 80):
        assert S.kth_key(df, 3, ["row_id"], k)[1] == [order[k - 1]]

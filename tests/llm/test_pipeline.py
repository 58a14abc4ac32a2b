"""The stages against brute force on a small table, and edge rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from kernelspark.llm import quality as Q
from kernelspark.llm.common import shared_table

from .test_simhash import plain_components, plain_fingerprint

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    out = []
    for k, (_, f) in enumerate(C.STAGES):
        docs = shared_table(f(spark, docs, DIR), "stage")
        assert docs.columns[:5] == columns and (k == len(C.STAGES) - 1 or docs.columns == columns)
        out.append({} if k > 2 else {r.doc_id: r for r in docs.collect()})
    good, unique, near = out[:3]
    whole = spark.read.parquet(f"{DIR}/documents.parquet")
    scored = Q.quality_scores(whole, spark.read.parquet(f"{DIR}/labels.parquet")).filter("predicted = 1")
    assert {r.doc_id for r in scored.collect()} == set(good)
    best = {}
    for r in good.values():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert {d for _, d in best.values()} == set(unique)
    ids = sorted(unique)
    roots = plain_components(ids, [plain_fingerprint(unique[i].text) for i in ids])
    assert set(roots.values()) == set(near)
    final = docs.collect()
    assert {r.doc_id for r in final} <= set(near) and max(Counter(r.doc_id for r in final).values()) <= 3
    assert all(r.round_trip and r.text == near[r.doc_id].text for r in final)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    total = sum(map(size, near.values()))
    assert abs(sum(map(size, final)) - total) <= 20 * max(map(size, near.values()))


def test_run_and_edge_rows(spark, tmp_path):
    rows = [(i, f"some words of text number {i} " * 12, "en", f"s{i % 3}", 1, i) for i in range(30)]
    rows += [(30, None, None, None, None, 0), (31, "", "en", "s0", 0, 0), (32, rows[0][1] + " ", "en", "s0", 1, 0), (33, "x " * 60000, "en", "s1", 1, 0),
             (33, "x " * 60000, "en", "s1", 1, 0), (None, "no id here", "en", "s2", 1, 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone bigint"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = C.run(spark, str(tmp_path))
    assert got.columns == [*df.columns, "n_tokens", "token_ids", "round_trip"]
    assert got.filter(~F.col("round_trip")).count() == 0 and got.count() > 0
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(empty / "labels.parquet"))
    assert C.run(spark, str(empty)).count() == 0

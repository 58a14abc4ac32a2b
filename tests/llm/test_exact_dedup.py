"""op8: edge rows, a hot group, the plan. The query itself has an SQL twin."""

from kernelspark.llm import exact_dedup as E


def test_edge_rows(spark):
    big = "word " * 50000
    rows = [(5, "a b", 1), (3, "ab", 1), (4, "a\tb\n", 1), (1, None, 1), (2, "", 1), (0, " \x0b", 1), (7, big, 1), (6, big.strip(), 1),
            (9, "x", 1), (9, "x", 1), (None, "ab", 1), (None, "q", 1), (8, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, norm int")
    got = {(r.doc_id, r.text_sha256): r for r in E.exact_dedup(df, salts=4).collect()}
    by = {k[0]: r for k, r in got.items() if k[0] is not None}
    assert E.exact_dedup(df).count() == len(rows)
    assert by[4].keep_id == 4 and by[5].keep_id == 4 and by[3].keep_id == 4 and by[3].group_size == 4     # longest original
    assert by[0].keep_id == 0 and by[1].keep_id == 0 and by[2].keep_id == 0       # empty: two characters beat none
    assert by[7].keep_id == 7 and not by[6].kept and by[7].kept
    assert by[9].group_size == 2 and by[9].kept and by[8].group_size == 1
    kept = E.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "4", "7", "8", "9", "9", "None"]
    assert E.exact_dedup(df.limit(0)).count() == 0


def test_hot_group_spreads(spark):
    df = spark.range(30000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text").repartition(8)
    got = E.exact_dedup(df).groupBy("group_size").count().collect()
    assert {r["group_size"]: r["count"] for r in got} == {10000: 10000, 1: 20000}
    assert E.exact_dedup(df).filter("group_size > 1 AND keep_id != 0").count() == 0


def test_plan_is_native_and_sorted_by_content(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = E.content_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(head" in plan and "SortAggregate" in plan and "Python" not in plan

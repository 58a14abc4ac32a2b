"""Physical-plan checks: the shapes that matter at scale."""

from conftest import SF001
from kernelspark.plans.queries import QUERIES


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_scan_and_one_global_aggregate(spark):
    plan = _final_plan(QUERIES["scoring"](spark, SF001))
    assert "SinglePartition" in plan and "hashpartitioning" not in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # only the four used columns are read
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan


def test_global_rank_has_no_window_over_rows(spark):
    plan = _final_plan(QUERIES["row_positions"](spark, SF001))
    # the sorted ranges are read back; only the per-range counts (a row per range) meet in one task
    assert "rank-" in plan and "row_number" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("SinglePartition") == plan.count("Exchange SinglePartition") <= 2


def test_permutation_reads_its_input_twice(spark):
    plan = _final_plan(QUERIES["random_permutation"](spark, SF001))
    assert plan.split("Initial Plan")[0].count("FileScan parquet") <= 2
    assert len(plan) < 40_000         # nothing grows with the number of ranges


def test_fit_reads_a_joined_input_once(spark):
    from conftest import rows_df
    from kernelspark.operators import svm as SVM
    rows = rows_df(spark, [[float(i % 7), float(i % 3)] for i in range(60)], [1.0 if i % 7 > 3 else -1.0 for i in range(60)])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    counted = rows.mapInArrow(count, rows.schema).join(spark.range(60).withColumnRenamed("id", "row_id"), "row_id")
    SVM.fit_svm(counted, solver="newton", max_iter=5)
    assert seen.value <= 2 * 60       # once for the width of the first row, once for the design


def test_per_group_sample_limits_before_the_shuffle(spark):
    plan = _final_plan(QUERIES["sample_landmarks"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_center_distances_need_no_join(spark):
    plan = _final_plan(QUERIES["point_center_distance"](spark, SF001))
    assert "Join" not in plan and "Exchange" not in plan

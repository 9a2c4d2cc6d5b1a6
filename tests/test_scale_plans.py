"""Plans of steps that larger tables made slow or large: what they no longer sort, shuffle or build twice."""

import pytest
from pyspark.sql import functions as F

from conftest import ts
from fanlens.operators import cohort, flows, segments
from fanlens.params import FIXED, FLOWING
from fanlens.sources.interactions import orders_interactions, orders_interactions_sentinel


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """Orders 1 (two lines), 2 (twice, a line), 3 (no line), one without key; a line of no order and one without supplier."""
    day = "timestamp_ntz'2024-01-05 00:00:00'"
    spark.sql(f"SELECT * FROM VALUES (1L, 7L, {day}), (2L, 8L, {day}), (2L, 8L, {day}), (3L, 9L, {day}), (NULL, 9L, {day}) t(o_orderkey, o_custkey, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 1L), (1L, 2L), (2L, 2L), (4L, 1L), (1L, NULL), (NULL, 1L) t(l_orderkey, l_suppkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 0), (2L, 24) t(s_suppkey, s_nationkey)").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_lines_meet_their_orders_without_being_sorted(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        plan = _plan(orders_interactions(spark, tables).groupBy("uid").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [l_orderkey" in plan and "SortMergeJoin [l_orderkey" not in plan


def test_log_holds_every_line_of_every_order(spark, tables):
    got = sorted((r.uid, r.entity) for r in orders_interactions_sentinel(spark, tables).collect())
    assert got == [(7, -3), (7, 1), (8, -3), (8, -3)]


def _by_user(spark, rows, schema):
    df = spark.createDataFrame(rows, schema).repartition("uid").persist()
    df.count()
    return df


def test_layer_funnel_shuffles_counts_only(spark):
    """Literal stages, on first touches of which some come twice; pairs by user are read in one pass."""
    jan, feb, mar = ts("2024-01-01"), ts("2024-02-01"), ts("2024-03-01")
    ft = _by_user(
        spark,
        [(1, 1, jan), (1, 1, feb), (2, 1, jan), (2, 1, mar), (3, 1, jan), (3, 1, feb), (4, 1, jan), (4, None, jan), (4, None, feb), (None, 1, jan), (None, 1, feb), (5, 1, jan), (5, 1, feb), (5, 1, feb)],
        "uid long, entity long, month timestamp_ntz",
    )
    labels = _by_user(spark, [(1, 9, FIXED), (2, 1, FIXED), (2, 2, FIXED), (3, 1, FLOWING), (4, 1, FIXED), (5, 1, FIXED), (None, 1, FIXED)], "uid long, entity long, label int")
    was = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")  # Spark's default
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cohort.cohort_layer_funnel(ft, labels)
        assert _plan(out).count("Exchange hashpartitioning(") - _plan(out).count("Exchange hashpartitioning(uid") == 1
        got = sorted((r.entity or 0, r.cohort_month, r.stage_ord, r.users, round(r.pct, 6)) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", was)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [
        (0, jan, 1, 1, 1.0), (0, feb, 1, 1, 1.0),
        (1, jan, 1, 6, 1.0), (1, jan, 2, 2, round(2 / 6, 6)), (1, jan, 3, 1, round(1 / 6, 6)),
        (1, feb, 1, 5, 1.0), (1, mar, 1, 1, 1.0),
    ]


def test_flow_target_builds_the_timelines_once(spark):
    jan, feb, mar = ts("2024-01-01"), ts("2024-02-01"), ts("2024-03-01")
    pm = _by_user(
        spark,
        [(1, 1, jan, 1), (1, 1, feb, 5), (1, 2, feb, 2), (1, 3, mar, 2), (2, 1, jan, 1), (3, 1, jan, 1), (3, 1, mar, 4), (4, 4, jan, 1), (4, 5, feb, 3), (4, 6, mar, 3)],
        "uid long, entity long, month timestamp_ntz, n long",
    )
    ft = pm.groupBy("uid", "entity").agg(F.min("month").alias("month"))
    out = flows.flow_target(ft, pm)
    assert _plan(out).count("Window [max(key") == 1
    got = sorted((r.uid, r.source, r.month, r.target) for r in out.collect())
    assert got == [
        (1, 1, jan, 2), (1, 2, feb, 3), (1, 3, mar, -3), (2, 1, jan, -3), (3, 1, jan, -3),
        (4, 4, jan, 5), (4, 5, feb, 6), (4, 6, mar, -3),
    ]


def test_vectors_are_checked_without_grouping_all_users(spark):
    """Entities and the least number of users come from one reading of the cells, in a job or two."""
    cells = _by_user(spark, [(1, 30), (1, 4), (2, 4), (None, 4), (3, None)], "uid long, entity long")
    spark.sparkContext.setJobGroup("vectors", "")
    try:
        vec = segments.incidence_vectors(cells)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("vectors")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2
    assert {r.uid: r.features.toArray().tolist() for r in vec.collect()} == {1: [1, 1], 2: [1, 0], 3: [0, 0], None: [1, 0]}


@pytest.mark.parametrize(("rows", "enough"), [([(1, 1), (1, 2)], False), ([(1, 1), (2, 1)], False), ([(1, 1), (2, 2)], True), ([(None, 1), (2, 2)], True), ([(None, 1), (None, 2)], False)])
def test_vectors_need_two_users_and_entities(spark, rows, enough):
    cells = spark.createDataFrame(rows, "uid long, entity long")
    if enough:
        assert segments.incidence_vectors(cells).count() == 2
    else:
        with pytest.raises(ValueError, match="2 x 2"):
            segments.incidence_vectors(cells)

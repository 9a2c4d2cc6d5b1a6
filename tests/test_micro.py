"""Hand-computed micro fixtures: ties, inclusive boundaries, sentinels, degenerate literals."""

from pyspark.sql import functions as F

from fanlens.operators import activity, churn, cohort, flows, labels, selection
from fanlens.params import FIXED, FLOWING, ROAMING
from fanlens.plans.model import AudienceModel


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_source_tie_goes_to_smallest_id(make_log):
    ia = make_log(
        [
            (1, 7, "2024-01-05 10:00:00"),
            (1, 3, "2024-01-06 10:00:00"),
            (1, 9, "2024-02-03 10:00:00"),  # first touch of 9 in Feb: 7 and 3 tied before
        ]
    )
    m = AudienceModel(ia, persist=False)
    fs = m.flow_source.filter("target = 9").first()
    assert fs["source"] == 3


def test_same_month_other_entity_is_neither_source_nor_target(make_log):
    ia = make_log([(1, 1, "2024-01-02 00:00:00"), (1, 2, "2024-01-20 00:00:00")])
    m = AudienceModel(ia, persist=False)
    assert rows(m.flow_source, "target", "source") == [(1, ROAMING), (2, ROAMING)]
    assert rows(m.flow_target, "source", "target") == [(1, ROAMING), (2, ROAMING)]


def test_target_excludes_own_entity_and_uses_runner_up(make_log):
    ia = make_log(
        [
            (1, 5, "2024-01-02 00:00:00"),
            (1, 5, "2024-03-02 00:00:00"),
            (1, 5, "2024-03-03 00:00:00"),
            (1, 8, "2024-03-04 00:00:00"),
            (1, 6, "2024-04-04 00:00:00"),
        ]
    )
    m = AudienceModel(ia, persist=False)
    # after Feb: 5 has 2 events (own entity, excluded), 6 and 8 tie with 1 -> 6
    assert m.flow_target.filter("source = 5").first()["target"] == 6


def test_activation_boundary_is_inclusive_to_the_microsecond(make_log):
    ia = make_log(
        [
            (1, 1, "2024-03-08 00:00:00"),  # month start + 7 days exactly
            (2, 1, "2024-03-08 00:00:00.000001"),
        ]
    )
    core = AudienceModel(ia, persist=False).funnel_core.first()
    assert (core["acq"], core["activ"]) == (2, 1)


def test_retention_and_revenue_edges(make_log):
    ia = make_log(
        [
            (1, 1, "2024-03-01 12:00:00"),
            (1, 1, "2024-03-28 00:00:00"),  # +27d: retained
            (1, 1, "2024-03-31 00:00:00"),  # +30d exactly: counts for revenue
            (1, 1, "2024-03-31 00:00:01"),  # after +30d: no revenue
            (2, 1, "2024-03-02 00:00:00"),
            (2, 1, "2024-04-03 00:00:00.5"),  # after +33d: not retained
        ]
    )
    c = AudienceModel(ia, persist=False).funnel_core.filter("month = '2024-03-01'").first()
    assert (c["reten"], c["revenue"]) == (1, 3 + 1)


def test_recency_counts_day_boundaries(make_log):
    ia = make_log([(1, 1, "2024-01-01 23:59:00"), (2, 1, "2024-01-02 00:01:00")])
    m = AudienceModel(ia, persist=False)
    assert rows(m.pair_stats, "uid", "recency_days") == [(1, 1), (2, 0)]


def test_modal_label_ties_and_closed_form(make_log, spark):
    lab = spark.createDataFrame(
        [(1, 1, FLOWING), (2, 1, FLOWING), (2, 2, FLOWING), (3, 1, FIXED), (3, 2, FLOWING), (4, 1, FIXED), (4, 2, FLOWING), (4, 3, FLOWING)],
        "uid long, entity long, label int",
    )
    glob = labels.user_global_label(lab)
    aug = labels.pair_label_augmented(lab, glob)
    by_mode = rows(labels.user_modal_label(aug), "uid", "global_label")
    closed = rows(labels.user_modal_label_from_pairs(lab), "uid", "global_label")
    assert by_mode == closed == [(1, ROAMING), (2, FLOWING), (3, FIXED), (4, FLOWING)]
    assert aug.count() == lab.count() + 2


def test_growth_params_need_five_points_and_stage_bands(spark):
    from fanlens.operators import growth

    seq = spark.createDataFrame(
        [(1, i, 10, i) for i in range(4)] + [(2, i, 10 + i, i) for i in range(5)], "entity long, month int, mau long, seq long"
    )
    params = growth.growth_params_init(seq)
    assert rows(params, "entity") == [(2,)]
    p = params.first()
    assert abs(p["K"] - 14 * 1.2) < 1e-12 and p["t0"] == 2.5
    st = spark.createDataFrame([(4.5, 2.5), (4.6, 2.5), (0.4, 2.5)], "seq double, t0 double")
    got = [r[0] for r in st.select(growth.stage_of("seq", "t0")).collect()]
    assert got == ["accelerate", "peak_sprint", "takeoff"]


def test_zero_flowing_gives_null_churn_and_series_drops_it(spark):
    mi = spark.createDataFrame([(1, "2024-01-01", ROAMING, 2)], "target long, month string, source long, cnt long").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )
    mo = spark.createDataFrame([(1, "2024-02-01", ROAMING, 1)], "source long, month string, target long, cnt long").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )
    eal = spark.createDataFrame(
        [("2024-01-01", 1, 5, 5, 0, 0), ("2024-02-01", 1, 4, 2, 2, 0)],
        "month string, entity long, mau long, fixed_mau long, flowing_mau long, roaming_mau long",
    ).withColumn("month", F.col("month").cast("timestamp_ntz"))
    out = churn.entity_flow_net_churn(mi, mo, eal)
    got = {str(r["month"])[:10]: (r["net_flow"], r["churn_rate"]) for r in out.collect()}
    assert got == {"2024-01-01": (2, None), "2024-02-01": (-1, 0.5)}
    series = selection.churn_series(out, None)
    assert [str(r["month"])[:10] for r in series.collect()] == ["2024-02-01"]


def test_literal_layer_funnel_only_new_and_v2_three_stages(make_log):
    ia = make_log(
        [(u, 1, f"2024-0{m}-10 00:00:00") for u in (1, 2, 3) for m in (1, 2, 3, 4, 5, 6)]
        + [(4, 1, "2024-01-10 00:00:00")]
    )
    m = AudienceModel(ia, persist=False)
    lit = m.cohort_layer_funnel
    assert {r["stage"] for r in lit.collect()} == {"new"}
    v2 = cohort.cohort_layer_funnel_v2(m.first_touch, m.pair_label, m.pair_months)
    assert {r["stage"] for r in v2.collect()} == {"new", "month1_fixed", "month2_fixed"}


def test_cohort_age_can_be_negative(make_log):
    ia = make_log(
        [(1, 2, "2024-01-05 00:00:00")]
        + [(1, 1, f"2024-0{m}-05 00:00:00") for m in (3, 4, 5, 6, 7)]
        + [(2, 1, "2024-07-01 00:00:00")]
    )
    m = AudienceModel(ia, persist=False)
    ages = {r["month_age"] for r in m.cohort_retention.collect()}
    assert min(ages) < 0


def test_unnamed_entity_dropped_from_pivot(spark):
    src = spark.createDataFrame(
        [("2024-01-01", 1, 3), ("2024-01-01", ROAMING, 4), ("2024-02-01", 2, 1)], "month string, source long, cnt long"
    ).withColumn("month", F.col("month").cast("timestamp_ntz"))
    dim = spark.createDataFrame([(1, "A"), (2, "B")], "entity long, name string")
    piv = selection.flow_pivot(selection.named_flows(src, dim, "source"), [r["name"] for r in dim.orderBy("name").collect()])
    assert piv.columns == ["month", "A", "B"]
    assert rows(piv, "month", "A", "B") == [("2024-01", 3, 0), ("2024-02", 0, 1)]


def test_month_in_one_matrix_only_counts_zero_other_side(spark):
    mi = spark.createDataFrame([(1, "2024-01-01", ROAMING, 3)], "target long, month string, source long, cnt long").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )
    mo = spark.createDataFrame([(1, "2024-03-01", ROAMING, 2)], "source long, month string, target long, cnt long").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )
    layers = spark.createDataFrame(
        [("2024-01-01", 3, 0, 3, 0), ("2024-03-01", 4, 0, 4, 0)], "month string, mau long, fixed_mau long, flowing_mau long, roaming_mau long"
    ).withColumn("month", F.col("month").cast("timestamp_ntz"))
    got = {str(r["month"])[:10]: r["net_flow"] for r in churn.flow_net_churn(mi, mo, layers).collect()}
    assert got == {"2024-01-01": 3, "2024-03-01": -2}


def test_sentinel_rows_are_weak_and_excluded_from_real_entity_ops(make_log):
    ia = make_log([(1, ROAMING, "2024-01-01 10:00:00"), (1, 2, "2024-01-01 11:00:00"), (2, 2, "2024-01-02 00:00:00")])
    m = AudienceModel(ia, persist=False)
    assert rows(m.daily_type, "weak", "strong", "total") == [(0, 1, 1), (1, 1, 2)]
    assert {r["entity"] for r in m.monthly_active.collect()} == {2}
    assert rows(activity.entity_daily_type(m.pair_days), "entity", "weak") == [(2, 0), (2, 0)]


def test_interest_association_others_is_id_ordered_tail(spark):
    mi = spark.createDataFrame(
        [(9, "2024-01-01", s, c) for s, c in [(1, 1), (2, 50), (3, 40), (4, 5), (5, 30)]],
        "target long, month string, source long, cnt long",
    ).withColumn("month", F.col("month").cast("timestamp_ntz"))
    mo = spark.createDataFrame([], "source long, month timestamp_ntz, target long, cnt long")
    lit = rows(selection.interest_association(mi, mo, [9], top_n=3), "entity", "cnt")
    # top 3 by count: 2, 3, 5; literal "Others" = entities after position 3 in id order (4, 5) = 35
    assert lit == [(-999, 35), (2, 50), (3, 40), (5, 30)]
    v2 = rows(selection.interest_association(mi, mo, [9], top_n=3, true_rest=True), "entity", "cnt")
    assert v2 == [(-999, 6), (2, 50), (3, 40), (5, 30)]


def test_parameter_ranges_match_the_controls(spark):
    import pytest

    from fanlens.operators import segments

    empty = spark.createDataFrame([], "target long, month timestamp_ntz, source long, cnt long")
    with pytest.raises(ValueError):
        selection.interest_association(empty, empty.toDF("source", "month", "target", "cnt"), [1], top_n=2)
    with pytest.raises(ValueError):
        selection.top_active_users(spark.createDataFrame([], "uid long, entity long"), 50)
    with pytest.raises(ValueError):
        segments.kmeans_segments(spark.createDataFrame([], "uid long"), k=11)

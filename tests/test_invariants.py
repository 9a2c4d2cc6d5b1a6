"""Structural invariants on the sf0.01 F1 fixture."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from fanlens.params import ROAMING
from fanlens.plans.model import model_for


@pytest.fixture(scope="module")
def m(spark):
    return model_for(spark, SF_MID)


def _zero(df) -> bool:
    return df.limit(1).count() == 0


def test_layers_add_up(m):
    for df in (m.active_layers, m.entity_active_layers):
        assert _zero(df.filter(F.col("fixed_mau") + F.col("flowing_mau") + F.col("roaming_mau") != F.col("mau")))


def test_flow_matrices_sum_to_acquisition(m):
    acq = m.acquisition
    inn = m.flow_matrix_in.groupBy(F.col("target").alias("entity"), "month").agg(F.sum("cnt").alias("s"))
    out = m.flow_matrix_out.groupBy(F.col("source").alias("entity"), "month").agg(F.sum("cnt").alias("s"))
    for side in (inn, out):
        j = acq.join(side, ["entity", "month"], "full")
        assert _zero(j.filter(~F.col("acq").eqNullSafe(F.col("s"))))


def test_funnel_monotone(m):
    a = m.aarrr_metrics
    assert _zero(a.filter((F.col("activ") > F.col("acq")) | (F.col("reten") > F.col("acq"))))


def test_contribution_shares_sum_to_one(m):
    s = m.rfm_daily_contribution.groupBy("day", "entity").agg(F.sum("evt_ratio").alias("s"))
    assert _zero(s.filter(F.abs(F.col("s") - 1) > 1e-9))


def test_types_and_penetration_bounds(m):
    assert _zero(m.entity_daily_type.filter(F.col("weak") + F.col("strong") != F.col("total")))
    assert _zero(m.penetration.filter((F.col("penetration") <= 0) | (F.col("penetration") > 1)))


def test_label_domains(m):
    assert {r[0] for r in m.user_global_label.select("global_label").distinct().collect()} <= {-2, ROAMING}
    roaming = m.user_global_label.filter(F.col("global_label") == ROAMING).count()
    assert m.pair_label_augmented.count() == m.pair_label.count() + roaming


def test_literal_recency_score_never_three(m):
    assert _zero(m.rfm_user.filter(F.col("r") == 3))
    assert _zero(m.rfm_user.filter(F.col("rfm_code") != F.concat(F.col("r"), F.col("f"), F.col("m"))))


def test_durable_mode_checkpoints_and_matches(spark, m):
    from fanlens.plans.model import AudienceModel
    from fanlens.sources.interactions import orders_interactions

    d = AudienceModel(orders_interactions(spark, SF_MID), durable=True)
    try:
        for name in ("flow_source", "flow_target", "aarrr_metrics"):
            a, b = getattr(d, name), getattr(m, name)
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        d.release()

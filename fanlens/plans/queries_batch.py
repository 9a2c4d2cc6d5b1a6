"""Registered queries for the dataset builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanlens.operators import cohort, rfm
from fanlens.plans.registry import register, register_raw
from fanlens.plans import oracle
from fanlens.sources import dims, sinks
from fanlens.session import shared_path


@register_raw("d01_dim_entity", oracle.sql("SELECT entity, name FROM dim"))
def d01(spark, sf_dir):
    return dims.nation_entities(spark, sf_dir)


@register("d02_interactions", "SELECT uid, entity, ts, month FROM ev")
def d02(m):
    return m.events


@register("d03_first_touch", "SELECT uid, entity, month FROM ft")
def d03(m):
    return m.first_touch


@register("d04_pair_stats", "SELECT uid, entity, month_cnt, last_ts, recency_days FROM ps")
def d04(m):
    return m.pair_stats


@register("d05_entity_threshold", "SELECT entity, month_med, recency_75 FROM thr")
def d05(m):
    return m.entity_threshold


@register("d06_pair_label", "SELECT uid, entity, label FROM lbl")
def d06(m):
    return m.pair_label


@register("d07_user_global_label", "SELECT uid, global_label FROM ulabel")
def d07(m):
    return m.user_global_label


@register("d08_pair_label_augmented", "SELECT uid, entity, label FROM aug")
def d08(m):
    return m.pair_label_augmented


@register("d09_flow_source", "SELECT uid, target, month, source FROM fs")
def d09(m):
    return m.flow_source


@register("d10_flow_target", "SELECT uid, source, month, target FROM ftg")
def d10(m):
    return m.flow_target


@register("d11_flow_matrix_in", "SELECT target, month, source, cnt FROM mi")
def d11(m):
    return m.flow_matrix_in


@register("d12_flow_matrix_out", "SELECT source, month, target, cnt FROM mo")
def d12(m):
    return m.flow_matrix_out


@register("d13_acquisition", "SELECT entity, month, acq FROM acq")
def d13(m):
    return m.acquisition


@register("d14_activation", "SELECT entity, month, activ FROM activ")
def d14(m):
    from fanlens.operators import funnel

    return funnel.activation(m.funnel_core)


@register("d15_early_retention", "SELECT entity, month, reten FROM reten")
def d15(m):
    from fanlens.operators import funnel

    return funnel.early_retention(m.funnel_core)


@register("d16_referral", "SELECT entity, month, refer FROM refer")
def d16(m):
    return m.referral


@register("d17_revenue_proxy", "SELECT entity, month, revenue FROM rev")
def d17(m):
    from fanlens.operators import funnel

    return funnel.revenue_proxy(m.funnel_core)


@register("d18_aarrr_metrics", "SELECT * FROM aarrr")
def d18(m):
    return m.aarrr_metrics


@register("d19_rfm_base", "SELECT * FROM rfm_base")
def d19(m):
    return m.rfm_base


@register("d20_rfm_thresholds", "SELECT * FROM rfm_qt")
def d20(m):
    return m.rfm_thresholds


@register("d21_rfm_score", "SELECT * FROM rfm_score")
def d21(m):
    return m.rfm_score


@register("d22_rfm_user", "SELECT * FROM rfm")
def d22(m):
    return m.rfm_user


@register("d22_rfm_user_events", "SELECT * FROM rfm", fixture="f3")
def d22_events(m):
    return m.rfm_user


@register("d22_rfm_user_v2", "SELECT * FROM rfm_v2", fixture="f3")
def d22_v2(m):
    return rfm.rfm_user(rfm.rfm_score(m.rfm_base, m.rfm_thresholds, intended=True))


@register(
    "d23_segment_sizes",
    """SELECT g.global_label AS label, s.name, COUNT(*) AS users
FROM modal g JOIN (VALUES (-3, 'roaming'), (-2, 'fixed'), (-1, 'flowing')) s(label, name) ON s.label = g.global_label
GROUP BY g.global_label, s.name""",
)
def d23(m):
    seg = dims.segment_dim(m.spark).withColumn("label", F.col("label").cast("int"))
    return (
        m.user_modal_label.join(F.broadcast(seg), m.user_modal_label.global_label == seg.label)
        .groupBy("label", "name")
        .agg(F.count(F.lit(1)).alias("users"))
    )


@register("d24_daily_type", "SELECT * FROM dtype", fixture="f2")
def d24(m):
    return m.daily_type


@register("d25_cohort_retention", "SELECT * FROM cohort")
def d25(m):
    return m.cohort_retention


@register("d25_cohort_retention_v2", "SELECT * FROM cohort WHERE month_age >= 0")
def d25_v2(m):
    return cohort.cohort_retention(m.first_touch, m.pair_label, m.pair_months, min_age=0)


@register("d26_rfm_daily_contribution", "SELECT * FROM rdc")
def d26(m):
    return m.rfm_daily_contribution


@register("d26_rfm_daily_contribution_events", "SELECT * FROM rdc", fixture="f3")
def d26_events(m):
    return m.rfm_daily_contribution


@register("d27_user_modal_label", "SELECT uid, global_label FROM modal")
def d27(m):
    return m.user_modal_label


@register("d28_monthly_active", "SELECT month, entity, uid FROM ma")
def d28(m):
    return m.monthly_active


@register("d29_active_layers", "SELECT * FROM layers")
def d29(m):
    return m.active_layers


@register("d30_entity_active_layers", "SELECT * FROM elayers")
def d30(m):
    return m.entity_active_layers


@register("d31_penetration", "SELECT * FROM pen")
def d31(m):
    return m.penetration


@register("d32_flow_net_churn", "SELECT * FROM churn")
def d32(m):
    return m.flow_net_churn


@register("d33_growth_sequence", "SELECT entity, month, mau, seq FROM seq")
def d33(m):
    return m.growth_sequence


@register("d34_growth_params_init", "SELECT * FROM gparams")
def d34(m):
    return m.growth_params_init


@register(
    "d35_lifecycle_stage",
    "SELECT entity, month, mau, seq, K, r, t0, round(deriv, 9) AS deriv, stage FROM stages",
)
def d35(m):
    return m.lifecycle_stage.withColumn("deriv", F.round("deriv", 9))


@register("d36_cohort_layer_funnel", "SELECT * FROM lfunnel")
def d36(m):
    return m.cohort_layer_funnel


@register("d36_cohort_layer_funnel_v2", "SELECT * FROM lfunnel_v2")
def d36_v2(m):
    return cohort.cohort_layer_funnel_v2(m.first_touch, m.pair_label, m.pair_months)


@register("d37_layer_funnel_snapshot", "SELECT * FROM lfunnel")
def d37(m):
    path = shared_path(m.spark, "snapshots", "layer_funnel", unique=True)
    return sinks.snapshot(m.cohort_layer_funnel, path)


@register("d38_active_layers_totals", "SELECT * FROM totals")
def d38(m):
    return m.active_layers_totals


@register("d39_entity_daily_type", "SELECT * FROM edtype")
def d39(m):
    return m.entity_daily_type


@register("d39_entity_daily_type_sentinel", "SELECT * FROM edtype", fixture="f2")
def d39_sentinel(m):
    return m.entity_daily_type


@register("d40a_pre_daily_type", "SELECT day, entity, weak, strong, total FROM edtype")
def d40a(m):
    return m.entity_daily_type.select("day", "entity", "weak", "strong", "total")


@register(
    "d40b_pre_aarrr",
    "SELECT entity, month, acq, activ, reten, refer, revenue, activation_rate, retention_rate, referral_rate FROM aarrr",
)
def d40b(m):
    return m.aarrr_metrics.select(
        "entity", "month", "acq", "activ", "reten", "refer", "revenue",
        "activation_rate", "retention_rate", "referral_rate",
    )


@register("d40c_pre_churn", "SELECT entity, month, net_flow, churn_rate FROM echurn")
def d40c(m):
    return m.entity_flow_net_churn.select("entity", "month", "net_flow", "churn_rate")


@register("d40d_pre_penetration", "SELECT month, entity, mau, industry_mau, penetration, pct_change FROM pen")
def d40d(m):
    return m.penetration.select("month", "entity", "mau", "industry_mau", "penetration", "pct_change")


@register("d41_entity_flow_net_churn", "SELECT * FROM echurn")
def d41(m):
    return m.entity_flow_net_churn


@register("d41_entity_flow_net_churn_sentinel", "SELECT * FROM echurn", fixture="f2")
def d41_sentinel(m):
    return m.entity_flow_net_churn



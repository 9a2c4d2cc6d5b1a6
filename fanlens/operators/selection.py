"""Selection-scoped operators (the dashboard's query layer, A01-A43, A52-A53).

A selection is a frame of entity ids, a list of them, or ``None`` (everything);
names are resolved against the entity dim by a filter, and the relations are
semi-joined with what it leaves, however many ids share a name.  Where the
dashboard's default is "every entity of the dictionary", the dim is the selection.

"Latest row" style readings are computed for all keys at once with windows or
``max_by`` instead of a driver-side ``tail(1)``; global top-k uses
``orderBy().limit(k)`` (distributed top-k, bounded by k).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.select import Selection, drop_selected, keep_selected, mark_selected
from fanlens.functions.time import add_days, year_month
from fanlens import params as P
from fanlens.params import MIN_CLUSTER_USERS, OTHERS, ROAMING, RFM_HIGH_VALUE, STAGES, TOP_N_RANGE, check_range

ROAMING_NAME = "roaming"
OTHERS_NAME = "Others"


# --- A01 ------------------------------------------------------------------------
def select_entities(dim: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Rows of the dim whose name is selected; empty / None selection = all rows."""
    if not names:
        return dim
    return dim.filter(F.col("name").isin(list(names)))


def resolve_ids(dim: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Selected names -> ids; nothing selected -> every id of the dictionary."""
    return select_entities(dim, names).select("entity")


def with_names(df: DataFrame, dim: DataFrame, key: str = "entity", default: str | None = ROAMING_NAME) -> DataFrame:
    """Lookup join (left, broadcast-size dim), unknown ids -> ``default``."""
    d = dim.select(F.col("entity").alias(key), F.col("name"))
    out = df.join(d, key, "left")
    if default is not None:
        out = out.withColumn(
            "name",
            F.when(F.col(key) == OTHERS, F.lit(OTHERS_NAME)).otherwise(F.coalesce("name", F.lit(default))),
        )
    return out


# --- scale layers (A02-A05) -----------------------------------------------------
def layer_series(layers: DataFrame) -> DataFrame:
    return layers.select("month", "mau", "fixed_mau", "flowing_mau", "roaming_mau").orderBy("month")


def _latest(df: DataFrame, order: str, part: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.col(order).desc()) if part else None
    if w is None:
        top = df.agg(F.max(order).alias("_mx"))
        return df.join(F.broadcast(top), F.col(order) == F.col("_mx")).drop("_mx")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _fix_ratio(fixed: Column, mau: Column) -> Column:
    return F.when(mau > 0, fixed.cast("double") / mau.cast("double")).otherwise(F.lit(0.0))


def layer_health(layers: DataFrame) -> DataFrame:
    """Fixed share of the latest month with bands >0.55 / >0.4 / else."""
    last = _latest(layers, "month")
    ratio = _fix_ratio(F.col("fixed_mau"), F.col("mau"))
    band = F.when(ratio > P.FIXED_SHARE_HEALTHY, "healthy").when(ratio > P.FIXED_SHARE_MEDIUM, "medium").otherwise("unstable")
    return last.select("month", "mau", "fixed_mau", "flowing_mau", "roaming_mau", ratio.alias("fix_ratio"), band.alias("band"))


def entity_layer_series(eal: DataFrame, sel: Selection) -> DataFrame:
    """A04."""
    return keep_selected(eal, "entity", sel).select("month", "mau", "fixed_mau", "flowing_mau", "roaming_mau")


def entity_layer_health(eal: DataFrame) -> DataFrame:
    """Per entity, latest vs previous fixed share, direction and band (<0.4 / >0.7)."""
    w = Window.partitionBy("entity").orderBy("month")
    ratio = _fix_ratio(F.col("fixed_mau"), F.col("mau"))
    x = eal.select("entity", "month", "mau", "fixed_mau", "flowing_mau", "roaming_mau", ratio.alias("fix_ratio"))
    x = x.withColumn("prev_fix_ratio", F.coalesce(F.lag("fix_ratio").over(w), F.col("fix_ratio")))
    last = _latest(x, "month", ["entity"])
    band = F.when(F.col("fix_ratio") < P.ENTITY_SHARE_UNSTABLE, "unstable").when(F.col("fix_ratio") > P.ENTITY_SHARE_CORE, "core_stable")
    band = band.otherwise("growing")
    return last.select(
        "entity", "month", "mau", "fixed_mau", "flowing_mau", "roaming_mau", "fix_ratio", "prev_fix_ratio",
        F.when(F.col("fix_ratio") > F.col("prev_fix_ratio"), "up").otherwise("down").alias("trend"),
        F.abs(F.col("fix_ratio") - F.col("prev_fix_ratio")).alias("change"),
        band.alias("band"),
    )


# --- penetration readings (A06-A09) ---------------------------------------------
def named_penetration(pen: DataFrame, dim: DataFrame) -> DataFrame:
    return with_names(pen, dim).orderBy("month", "entity")


def penetration_share(pen: DataFrame) -> DataFrame:
    """Per-month 100 % normalisation of penetration."""
    tot = pen.groupBy("month").agg(F.sum("penetration").alias("_tot"))
    return pen.join(tot, "month").select(
        "month", "entity", "penetration", F.round(F.col("penetration") / F.col("_tot"), 9).alias("share")
    )


def top_concentration(pen: DataFrame, k: int = 3) -> DataFrame:
    """Sum of the k largest penetrations in the latest month; bands >0.6 / >0.4.

    The k largest are a distributed top-k (bounded by k), not a window over all entities."""
    last = _latest(pen, "month")
    top = last.orderBy(F.col("penetration").desc(), F.col("entity")).limit(k)
    s = F.sum("penetration")
    return top.groupBy("month").agg(
        F.round(s, 9).alias("top_penetration"),
        F.max_by("entity", F.struct(F.col("penetration"), -F.col("entity"))).alias("leader"),
        F.max("penetration").alias("leader_penetration"),
        F.when(s > P.TOP3_CONCENTRATED, "concentrated").when(s > P.TOP3_SEMI, "semi").otherwise("dispersed").alias("band"),
    )


def last_per_month(pen: DataFrame, by_penetration: bool = False) -> DataFrame:
    """The latest month's "last" row: largest entity id (or largest penetration)."""
    last = _latest(pen, "month")
    key = F.struct(F.col("penetration"), F.col("entity")) if by_penetration else F.col("entity")
    return last.groupBy("month").agg(
        F.max_by("entity", key).alias("entity"),
        F.max_by("penetration", key).alias("penetration"),
        F.max_by("pct_change", key).alias("pct_change"),
    )


# --- lifecycle readings (A16-A17) -----------------------------------------------
def stage_series(stages: DataFrame, dim: DataFrame) -> DataFrame:
    return with_names(stages.select("entity", "month", "mau", "seq", "stage"), dim).orderBy("entity", "seq")


def current_stage(stages: DataFrame) -> DataFrame:
    """Stage at the last seq per entity; pull-back / decline alerts."""
    cur = stages.groupBy("entity").agg(F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"))
    return cur.select(
        "entity", "seq", "stage",
        (F.col("stage") == STAGES[4]).alias("pullback_alert"),
        (F.col("stage") == STAGES[5]).alias("decline_alert"),
    )


# --- interest association (A18-A19) ---------------------------------------------
def association_totals(mi: DataFrame, mo: DataFrame, ids: Sequence[int], exclude_roaming: bool = False) -> DataFrame:
    """Sources into and targets out of the selection, summed per other entity."""
    src = keep_selected(mi, "target", ids).select(F.col("source").alias("entity"), "cnt")
    tgt = keep_selected(mo, "source", ids).select(F.col("target").alias("entity"), "cnt")
    tot = src.unionByName(tgt).groupBy("entity").agg(F.sum("cnt").alias("cnt"))
    tot = drop_selected(tot, "entity", ids)
    if exclude_roaming:
        tot = tot.filter(F.col("entity") != ROAMING)
    return tot


def interest_association(
    mi: DataFrame, mo: DataFrame, ids: Sequence[int], top_n: int = 8, exclude_roaming: bool = False, true_rest: bool = False
) -> DataFrame:
    """Top-N related entities (ties -> smaller id) plus one Others row (-999).

    Literal "Others" = the entities after position N in id order (Q13);
    ``true_rest`` = everything not in the top N."""
    check_range("top_n", top_n, *TOP_N_RANGE)
    tot = association_totals(mi, mo, ids, exclude_roaming)
    top = tot.orderBy(F.col("cnt").desc(), F.col("entity")).limit(top_n)
    head = top if true_rest else tot.orderBy("entity").limit(top_n)
    rest = tot.agg(F.sum("cnt").alias("a")).crossJoin(head.agg(F.sum("cnt").alias("b"))).select(
        F.lit(OTHERS).cast("bigint").alias("entity"), (F.col("a") - F.coalesce(F.col("b"), F.lit(0))).alias("cnt")
    )
    return top.unionByName(rest.filter(F.col("cnt") > 0))


def cross_rate(assoc: DataFrame, k: int = 3) -> DataFrame:
    """Share of the non-Others rows; the top-k related; band >0.6."""
    agg = assoc.agg(
        F.sum("cnt").alias("den"), F.sum(F.when(F.col("entity") != OTHERS, F.col("cnt")).otherwise(0)).alias("num")
    ).select(F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0)).alias("cross_rate"))
    several = assoc.agg((F.count(F.lit(1)) > 1).alias("several"))  # one row alone is no rate
    assoc = assoc.join(F.broadcast(several), F.col("several")).drop("several")
    top = assoc.filter(F.col("entity") != OTHERS).orderBy(F.col("cnt").desc(), F.col("entity")).limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cnt").desc(), F.col("entity"))).cast("bigint"))
    return top.crossJoin(agg).select(
        "rank", "entity", "cnt", "cross_rate",
        F.when(F.col("cross_rate") > P.CROSS_RATE_HIGH, "high_flow").otherwise("sticky").alias("band"),
    )


# --- event types (A20-A22) ------------------------------------------------------
def selected_daily_type(edt: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """Per day sums of the selected entities (days without them stay with 0)."""
    marked = mark_selected(edt, "entity", ids, "picked")
    return marked.groupBy("day").agg(
        *[F.sum(F.when(F.col("picked"), F.col(c)).otherwise(0)).alias(c) for c in ("weak", "strong", "total")]
    )


def unpivot_type(df: DataFrame) -> DataFrame:
    """weak/strong columns -> (day, type, cnt) rows."""
    return df.unpivot("day", ["weak", "strong"], "type", "cnt")


def weak_share(long: DataFrame, days: int = 7) -> DataFrame:
    """Weak share overall and in the last ``days`` days; direction and band."""
    mx = long.agg(F.max("day").alias("_mx"))
    x = long.crossJoin(F.broadcast(mx))
    recent = F.col("day") > add_days(F.col("_mx"), -days)
    weak = F.col("type") == "weak"

    def share(cond):
        den = F.sum(F.when(cond, F.col("cnt")).otherwise(0))
        num = F.sum(F.when(cond & weak, F.col("cnt")).otherwise(0))
        return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))

    out = x.agg(share(F.lit(True)).alias("weak_share"), share(recent).alias("weak_recent"))
    return out.select(
        "weak_share",
        (F.lit(1.0) - F.col("weak_share")).alias("strong_share"),
        "weak_recent",
        F.when(F.col("weak_recent") > F.col("weak_share"), "up").otherwise("down").alias("trend"),
        F.when(F.col("weak_share") > P.WEAK_SHARE_WATCHING, "watching").when(F.col("weak_share") > P.WEAK_SHARE_BALANCED, "balanced")
        .otherwise("engaged").alias("band"),
    )


# --- monthly trend & flow matrices (A23-A28) ------------------------------------
def monthly_trend(mi: DataFrame, ids: Sequence[int], mo: DataFrame | None = None) -> DataFrame:
    """new = inflow to the selection; lost = from the inflow matrix (literal) or ``mo``."""
    new = F.sum(F.when(F.col("into"), F.col("cnt")).otherwise(0))
    lost = F.sum(F.when(F.col("out_of"), F.col("cnt")).otherwise(0))
    mi = mark_selected(mi, "target", ids, "into")
    if mo is None:
        return mark_selected(mi, "source", ids, "out_of").groupBy("month").agg(new.alias("new_users"), lost.alias("lost_users"))
    a = mi.groupBy("month").agg(new.alias("new_users"))
    b = mark_selected(mo, "source", ids, "out_of").groupBy("month").agg(lost.alias("lost_users"))
    return a.join(b, "month", "full").select(
        "month",
        F.coalesce("new_users", F.lit(0).cast("bigint")).alias("new_users"),
        F.coalesce("lost_users", F.lit(0).cast("bigint")).alias("lost_users"),
    )


def net_inflow(trend: DataFrame) -> DataFrame:
    """A24."""
    return trend.agg((F.sum("new_users") - F.sum("lost_users")).alias("net")).select(
        "net", F.when(F.col("net") > 0, "positive").otherwise("negative").alias("direction")
    )


def selected_sources(mi: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Month, source -> users flowing into the selection."""
    return keep_selected(mi, "target", ids).groupBy("month", "source").agg(F.sum("cnt").alias("cnt"))


def selected_targets(mo: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Month, target -> users flowing out of the selection."""
    return keep_selected(mo, "source", ids).groupBy("month", "target").agg(F.sum("cnt").alias("cnt"))


def named_flows(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Month label + entity name; entities without a name drop out (Q17)."""
    return with_names(df, dim, key, default=None).filter(F.col("name").isNotNull()).select(
        year_month("month").alias("month"), "name", "cnt"
    )


def flow_pivot(named: DataFrame, names: Sequence[str]) -> DataFrame:
    """Month x name matrix of the mean count, 0-filled, integer.

    ``names`` are the columns, so the schema is fixed and no job looks for them; a
    conditional mean for each has no limit on their number."""
    cell = lambda c: F.avg(F.when(F.col("name") == c, F.col("cnt")))
    return named.groupBy("month").agg(*[F.coalesce(cell(c), F.lit(0.0)).cast("bigint").alias(c) for c in names])


def top_flow_partner(src_named: DataFrame, tgt_named: DataFrame) -> DataFrame:
    """In each direction's latest month, the name with the largest count (ties -> first name).

    A direction with fewer than two named partners is not charted: no row for it."""

    def best(df: DataFrame, direction: str) -> DataFrame:
        cell = df.groupBy("month", "name").agg(F.avg("cnt").alias("cnt"))
        several = cell.agg((F.min("name") != F.max("name")).alias("several"))  # one row
        last = _latest(cell, "month").join(F.broadcast(several), F.col("several"))
        return last.orderBy(F.col("cnt").desc(), F.col("name")).limit(1).select(
            F.lit(direction).alias("direction"), "month", "name", F.col("cnt").cast("bigint").alias("cnt")
        )

    return best(src_named, "source").unionByName(best(tgt_named, "target"))


# --- AARRR readings (A30-A33) ---------------------------------------------------
def available_months(df: DataFrame, ids: Sequence[int] | None, col: str = "month") -> DataFrame:
    """Distinct months of the selection as ``yyyy-MM``."""
    return keep_selected(df, "entity", ids).select(year_month(col).alias(col)).distinct().orderBy(col)


def _pick_month(df: DataFrame, ids, col: str, latest: bool) -> DataFrame:
    sel = keep_selected(df, "entity", ids)
    pick = sel.agg((F.max(col) if latest else F.min(col)).alias("_m"))
    return sel.join(F.broadcast(pick), F.col(col) == F.col("_m")).drop("_m")


FUNNEL_COLS = ("acq", "activ", "reten", "refer", "revenue")


def funnel_totals(aarrr: DataFrame, ids: Sequence[int] | None, month: str | None = None) -> DataFrame:
    """Sums of the five steps for one month (default: the earliest available)."""
    if month is None:
        sel = _pick_month(aarrr, ids, "month", latest=False)
    else:
        sel = keep_selected(aarrr.filter(F.col("month") == F.lit(month).cast("timestamp_ntz")), "entity", ids)
    return sel.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in FUNNEL_COLS])


def funnel_steps(tot: DataFrame) -> DataFrame:
    """Ordered steps acq -> activ -> reten -> revenue -> refer with % of the first."""
    order = ["acq", "activ", "reten", "revenue", "refer"]
    stack = ", ".join(f"{i + 1}, '{c}', {c}" for i, c in enumerate(order))
    long = tot.selectExpr("acq AS _first", f"stack({len(order)}, {stack}) AS (step_ord, step, value)")
    return long.select(
        "step_ord", "step", "value", F.when(F.col("_first") > 0, F.col("value") / F.col("_first")).alias("pct_initial")
    )


def weakest_step(tot: DataFrame) -> DataFrame:
    """Smallest of activ/reten/refer over max(acq, 1); flag below 0.2."""
    den = F.greatest(F.col("acq"), F.lit(1)).cast("double")
    long = tot.selectExpr("acq", "stack(3, 1, 'activ', activ, 2, 'reten', reten, 3, 'refer', refer) AS (ord, step, v)")
    rates = long.select("ord", "step", (F.col("v") / den).alias("rate"))
    best = rates.agg(F.min_by("step", F.struct("rate", "ord")).alias("step"), F.min("rate").alias("rate"))
    return best.withColumn("flag", F.col("rate") < P.FUNNEL_STEP_WEAK)


# --- layer funnel readings (A34-A36) --------------------------------------------
def layer_funnel_totals(lf: DataFrame, ids: Sequence[int] | None, month: str | None = None) -> DataFrame:
    """Per stage sum of users and ratio to the first stage (default month: latest)."""
    if month is None:
        sel = _pick_month(lf, ids, "cohort_month", latest=True)
    else:
        sel = keep_selected(lf.filter(F.col("cohort_month") == F.lit(month).cast("timestamp_ntz")), "entity", ids)
    agg = sel.groupBy("stage_ord", "stage").agg(F.sum("users").alias("users"))
    first = F.first("users").over(Window.orderBy("stage_ord"))
    return agg.select("stage_ord", "stage", "users", (F.col("users") / first).alias("pct"))


def layer_conversion(tot: DataFrame) -> DataFrame:
    """Percent of previous stage; overall conversion stage3/stage1 when >= 3 stages."""
    w = Window.orderBy("stage_ord")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    first = F.first("users").over(w)
    third = F.max(F.when(F.col("stage_ord") == 3, F.col("users"))).over(Window.partitionBy())
    return tot.select(
        "stage_ord", "stage", "users",
        (F.col("users") / F.lag("users").over(w)).alias("pct_previous"),
        F.when(n >= 3, third / first).alias("conversion"),
    )


# --- churn readings (A37-A38) ---------------------------------------------------
def churn_series(efnc: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """Per month sum of net flow and unweighted mean churn rate (non-null only)."""
    return (
        keep_selected(efnc, "entity", ids)
        .groupBy("month")
        .agg(F.sum("net_flow").alias("net_flow"), F.round(F.avg("churn_rate"), 9).alias("churn_rate"))
        .filter(F.col("churn_rate").isNotNull())
    )


def churn_latest(series: DataFrame) -> DataFrame:
    """Latest rate, its direction and whether it is near balance (|r| < CHURN_BALANCED)."""
    last = _latest(series, "month")
    r = F.col("churn_rate")
    return last.select(
        "month", "churn_rate",
        F.when(r < 0, "narrowing").otherwise("bleeding").alias("direction"),
        (F.abs(r) < P.CHURN_BALANCED).alias("balanced"),
    )


# --- loyalty (A39-A40) ----------------------------------------------------------
def cohort_curve(cr: DataFrame, max_age: int = 3) -> DataFrame:
    """Retained over the first value by age (literal: ages may be negative)."""
    x = cr.filter(F.col("month_age") <= max_age)
    first = F.first("retained").over(Window.partitionBy("cohort_month").orderBy("month_age"))
    return x.select("cohort_month", "month_age", "retained", first.alias("acquired")).withColumn(
        "rate", F.col("retained") / F.col("acquired")
    )


def mean_retention(curve: DataFrame, age: int = 1) -> DataFrame:
    """Mean rate at ``age``; band below 0.35."""
    return curve.filter(F.col("month_age") == age).agg(F.round(F.avg("rate"), 9).alias("mean_rate")).withColumn(
        "band", F.when(F.col("mean_rate") < P.RETENTION_WEAK, "weak").otherwise("healthy")
    )


# --- RFM readings (A41-A43, A52-A53) --------------------------------------------
def rfm_segments(rfm: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """A41."""
    return keep_selected(rfm, "entity", ids).groupBy("rfm_code", "rfm_tag").agg(F.count(F.lit(1)).alias("cnt"))


def rfm_histograms(seg: DataFrame) -> DataFrame:
    """Frequency of each code and of each tag over the segment rows."""
    code = seg.groupBy(F.col("rfm_code").alias("value")).agg(F.count(F.lit(1)).alias("freq")).withColumn("kind", F.lit("code"))
    tag = seg.groupBy(F.col("rfm_tag").alias("value")).agg(F.count(F.lit(1)).alias("freq")).withColumn("kind", F.lit("tag"))
    return code.unionByName(tag).select("kind", "value", "freq")


def rfm_histograms_weighted(seg: DataFrame) -> DataFrame:
    """A42 intent: users per code and per tag (sums ``cnt`` instead of counting rows)."""
    code = seg.groupBy(F.col("rfm_code").alias("value")).agg(F.sum("cnt").alias("freq")).withColumn("kind", F.lit("code"))
    tag = seg.groupBy(F.col("rfm_tag").alias("value")).agg(F.sum("cnt").alias("freq")).withColumn("kind", F.lit("tag"))
    return code.unionByName(tag).select("kind", "value", "freq")


def high_value_share(seg: DataFrame) -> DataFrame:
    """A43."""
    out = seg.agg(
        F.coalesce(F.sum(F.when(F.col("rfm_tag") == RFM_HIGH_VALUE, F.col("cnt"))), F.lit(0)).alias("high_value"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
    )
    share = F.when(F.col("total") > 0, F.col("high_value") / F.col("total")).otherwise(F.lit(0.0))
    return out.select("high_value", "total", share.alias("share"), F.when(share < P.HIGH_VALUE_LOW, "low").otherwise("high").alias("band"))


def rfm_contribution_series(rdc: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """Per (day, tag) summed event share of the selected entities."""
    return keep_selected(rdc, "entity", ids).groupBy("day", "rfm_tag").agg(F.round(F.sum("evt_ratio"), 9).alias("evt_ratio"))


def rfm_contribution_shares(series: DataFrame) -> DataFrame:
    """A52 intent: per day, each tag's share of the summed ratios (sums to 1 per day)."""
    tot = series.groupBy("day").agg(F.sum("evt_ratio").alias("_tot"))
    return series.join(tot, "day").select(
        "day", "rfm_tag", F.round(F.col("evt_ratio") / F.col("_tot"), 9).alias("share")
    )


def weakest_segment(series: DataFrame) -> DataFrame:
    """Each tag's value on its last day; the smallest (ties -> smaller tag); flag < 0.15."""
    last = series.dropna().groupBy("rfm_tag").agg(F.max_by("evt_ratio", "day").alias("evt_ratio"))
    return last.agg(F.min_by("rfm_tag", F.struct("evt_ratio", "rfm_tag")).alias("rfm_tag"), F.min("evt_ratio").alias("evt_ratio")).withColumn(
        "flag", F.col("evt_ratio") < P.SEGMENT_WEAK
    )


# --- raw-log readings (A44-A46) -------------------------------------------------
def distinct_users(ia: DataFrame) -> DataFrame:
    """A44."""
    return ia.agg(F.countDistinct("uid").alias("users"))


def cluster_events(ia: DataFrame, ids: Sequence[int] | None = None, exclude_roaming: bool = True) -> DataFrame:
    """(uid, entity) rows with optional selection and sentinel exclusion."""
    ev = ia.filter(F.col("entity") != ROAMING) if exclude_roaming else ia
    return keep_selected(ev, "entity", ids).select("uid", "entity")


def top_active_users(ev: DataFrame, n: int = 3000) -> DataFrame:
    """Events of the n users with most events (ties -> smaller uid).

    The top-n list is a distributed top-k bounded by n, then a semi-join."""
    check_range("max_users", n, MIN_CLUSTER_USERS)
    top = ev.groupBy("uid").agg(F.count(F.lit(1)).alias("events")).orderBy(F.col("events").desc(), F.col("uid")).limit(n)
    return ev.join(top.select("uid"), "uid", "left_semi")



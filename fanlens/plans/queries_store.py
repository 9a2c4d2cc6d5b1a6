"""Registered queries over stored tables that follow the log: roll-ups, user bitmaps, stored dims.

The log of a fixture is appended in three overlapping pulls; the maintained tables
must then equal what a full rebuild gives, so the oracles are those of the plain
relations over the whole log.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.functions.math import ratio
from fanlens.operators import bitmaps
from fanlens.operators.maintained import MaintainedLog
from fanlens.plans import oracle
from fanlens.plans.model import AudienceModel
from fanlens.plans.registry import register, register_raw
from fanlens.session import shared_path
from fanlens.sources.dim_store import StoredDim
from fanlens.sources.interactions import FIXTURES, table

#: (from, up to) of each pull of the F1 log; the last one returns everything
PULLS = ((None, "1998-01-01"), ("1997-06-01", "2000-06-01"), (None, None))
HASH_RANGES = 16  # the test tables have few users

_STORES: dict[tuple, tuple[MaintainedLog, AudienceModel]] = {}


def _maintained(spark, sf_dir) -> tuple[MaintainedLog, AudienceModel]:
    """The F1 log after its pulls, built once for an application and data folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
    if key not in _STORES:
        ia = FIXTURES["f1"](spark, sf_dir)
        store = MaintainedLog(spark, shared_path(spark, "maintained", unique=True), with_bitmaps=True, hash_ranges=HASH_RANGES)
        for first, end in PULLS:
            batch = ia if first is None else ia.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
            store.append(batch if end is None else batch.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        _STORES[key] = store, store.model()
    return _STORES[key]


def _register(name: str, final_sql: str):
    """A query of (store, model over its roll-ups), held against the relation of the whole log."""

    def deco(fn):
        register_raw(name, oracle.sql(final_sql))(lambda spark, sf_dir: fn(*_maintained(spark, sf_dir)))
        return fn

    return deco


@_register("a54_maintained_log", "SELECT uid, entity, ts, month FROM ev")
def a54_log(store, m):
    return store.log()


@_register(
    "a54_maintained_roll_up",
    """SELECT uid, entity, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, month, count(*) AS n, count(*) FILTER (ts = CAST(ts AS DATE)) AS n0,
       min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY ALL""",
)
def a54_roll_up(store, m):
    return store.pair_days()


@_register("d13_acquisition_maintained", "SELECT entity, month, acq FROM acq")
def d13_maintained(store, m):
    return m.acquisition


@_register("d18_aarrr_metrics_maintained", "SELECT * FROM aarrr")
def d18_maintained(store, m):
    return m.aarrr_metrics


@_register("d25_cohort_retention_maintained", "SELECT * FROM cohort")
def d25_maintained(store, m):
    return m.cohort_retention


@_register("d29_active_layers_maintained", "SELECT * FROM layers")
def d29_maintained(store, m):
    return m.active_layers


# --- distinct counts from stored bitmaps ------------------------------------------
def _real(store):
    return store.users.sets().where(F.col("entity") > 0)


@_register("d29_active_layers_bitmaps", "SELECT * FROM layers")
def d29_bitmaps(store, m):
    labels = store.users.label_sets(m.user_modal_label)
    return bitmaps.layers(bitmaps.united(_real(store), ["month"]), labels, ["month"])


@_register("d30_entity_active_layers_bitmaps", "SELECT * FROM elayers")
def d30_bitmaps(store, m):
    return bitmaps.layers(_real(store), store.users.label_sets(m.user_modal_label), ["month", "entity"])


@_register("d31_penetration_bitmaps", "SELECT month, entity, mau, industry_mau, penetration FROM pen")
def d31_bitmaps(store, m):
    site = bitmaps.counted(_real(store), ["month"], "industry_mau")
    mau = bitmaps.counted(_real(store), ["month", "entity"], "mau")
    return mau.join(site, "month").select("month", "entity", "mau", "industry_mau", ratio("mau", "industry_mau").alias("penetration"))


_SPANS = (("1995-01-01", "1995-12-01"), ("1996-05-01", "1998-02-01"), ("1990-01-01", "2020-01-01"))


@_register(
    "a44_distinct_users_bitmaps",
    " UNION ALL ".join(
        f"SELECT '{a}' AS since, '{b}' AS until, count(DISTINCT uid) AS users FROM ev WHERE month BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in _SPANS
    ),
)
def a44_bitmaps(store, m):
    """Users of several ranges of months, from the stored months."""
    out = None
    for first, last in _SPANS:
        span = bitmaps.month_range(store.users.sets(), first, last).select(F.lit(first).alias("since"), F.lit(last).alias("until"), "bucket", "bits")
        out = span if out is None else out.unionByName(span)
    return bitmaps.counted(out, ["since", "until"])


@register("d16_referral_bitmaps", "SELECT entity, month, refer FROM refer")
def d16_bitmaps(m):
    """Users that each entity sent on, by month: sets over a dictionary of the log's users."""
    users = bitmaps.numbered(m.pairs.select("uid"), hash_ranges=HASH_RANGES).select("uid", "number")
    sent = m.flow_source.where("source > 0").select("uid", F.col("source").alias("entity"), "month").join(users, "uid")
    return bitmaps.counted(bitmaps.user_sets(sent, ["entity", "month"]), ["entity", "month"], "refer")


@register("d30_entity_mau_sketches", None)
def d30_sketches(m):
    """Estimated monthly users of an entity and of all, from one table of sketches; tests hold the error against the count."""
    kept = bitmaps.sketches(m.monthly_active, ["month", "entity"]).checkpoint()
    site = bitmaps.estimated(kept, ["month"], "industry_mau")
    return bitmaps.estimated(kept, ["month", "entity"], "mau").join(site, "month")


# --- stored dims ---------------------------------------------------------------------
CUSTOMER_SCHEMA = T.StructType([T.StructField("uid", T.LongType()), T.StructField("name", T.StringType()), T.StructField("last_priority", T.StringType())])


@register_raw(
    "i09_stored_upsert",
    """SELECT c_custkey AS uid, c_name AS name, coalesce(arg_max(o_orderpriority, o_orderkey), 'none') AS last_priority
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def i09_stored_upsert(spark, sf_dir):
    """A user dim: every customer, then all orders' priorities as updates (the last order of a user wins), then the same again."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    dim = StoredDim(spark, shared_path(spark, "dims", "users", unique=True), CUSTOMER_SCHEMA, "uid", buckets=8)
    dim.upsert(users.select("uid", "name", F.lit("none").alias("last_priority"), F.lit(0).alias("at")), "at")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("last_priority"), F.col("o_orderkey").alias("at"))
    updates = orders.join(users, "uid")
    dim.upsert(updates, "at")
    dim.upsert(updates, "at")
    return dim.read()


@register_raw("d01_dim_entity_stored", oracle.sql("SELECT entity, name FROM dim"))
def d01_stored(spark, sf_dir):
    """Names of the entities of the log: first their numbers as names, then those the dictionary has."""
    from fanlens.sources.dim_store import entity_dim

    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("entity"), F.col("n_name").alias("name"), "n_nationkey")
    dim = entity_dim(spark, shared_path(spark, "dims", "entities", unique=True), buckets=4)
    dim.upsert(nation.select("entity", F.col("entity").cast("string").alias("name"), "n_nationkey"), "n_nationkey")
    dim.upsert(nation, "n_nationkey")
    return dim.read()

"""Registered queries for curve fitting (A10-A15), clustering (A47-A51),
ingestion (A54/T01, T02) and streaming (T03, T04).

Fits and clusterings are non-SQL: no oracle (the driver checks rows only).
Ingestion and streaming have oracles: their results are plain relations of
the ``events`` table.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fanlens.operators import curvefit, growth, ingest, segments
from fanlens.operators import selection as S
from fanlens.plans import oracle
from fanlens.plans.registry import register, register_raw
from fanlens.session import shared_path
from fanlens.sources import sinks
from fanlens.sources.interactions import EVENT_TYPE_ENTITY as _EVENT_TYPES
from fanlens.sources.interactions import FIXTURES
from fanlens.streaming.append import stream_append
from fanlens.streaming.daily import read_daily_type, run_daily_type


# --- A10-A15 ----------------------------------------------------------------------
def _fit(m):
    """D33's monthly users, fitted."""
    if "_fit_cache" not in m.__dict__:
        m.__dict__["_fit_cache"] = m._keep(curvefit.r_squared(m.growth_sequence, curvefit.logistic_fit(m.growth_sequence, m.p)))
    return m.__dict__["_fit_cache"]


@register("a10_logistic_fit", None)
def a10(m):
    return curvefit.logistic_fit(m.growth_sequence, m.p)


@register("a11_r_squared", None)
def a11(m):
    return _fit(m)


@register("a12_logistic_curve", None)
def a12(m):
    return curvefit.logistic_curve(m.growth_sequence, _fit(m), m.p.curve_points)


@register("a13_fit_quality", None)
def a13(m):
    return curvefit.fit_quality(m.growth_sequence, _fit(m))


@register("a14_headroom", None)
def a14(m):
    return curvefit.headroom(m.growth_sequence, _fit(m))


@register("a10_logistic_fit_cumulative", None)
def a10_cumulative(m):
    """The fit of users met so far by month: a series that only grows."""
    return curvefit.logistic_fit(growth.cumulative_acquisitions(m.acquisition), m.p)


@register("d35_lifecycle_stage_v2", None)
def d35_v2(m):
    """Q16 intent: lifecycle stages from the fitted curve instead of the initial guesses."""
    fitted = curvefit.logistic_fit(m.growth_sequence, m.p).select("entity", "K", "r", "t0")
    return growth.lifecycle_stage(m.growth_sequence, fitted)


@register("a15_export_params", None)
def a15(m):
    return sinks.export_csv(_fit(m), shared_path(m.spark, "exports", "scurve_params", unique=True))


# the same readings on the initial parameters (D34), which SQL can express
_AT = "g.K / (1 + exp(-g.r * ({t} - g.t0)))"
oracle._cte("rated", f"""
SELECT entity, K, r, t0, round(if(sst <> 0, 1 - sse / sst, 0), 9) AS R2 FROM (
  SELECT g.entity, g.K, g.r, g.t0, sum(pow(s.mau - {_AT.format(t="s.seq")}, 2)) AS sse,
         sum(pow(s.mau - mean, 2)) AS sst
  FROM gparams g JOIN (SELECT *, avg(mau) OVER (PARTITION BY entity) AS mean FROM seq) s USING (entity) GROUP BY ALL) errors
""")
oracle._cte("facts", """
SELECT entity, count(*) AS n, max(mau) AS y_max, min(mau) AS y_min, arg_max(mau, seq) AS y_last, max(seq) AS t_last, min(seq) AS t_first
FROM seq GROUP BY ALL
""")


def _rated(m):
    rated = curvefit.r_squared(m.growth_sequence, m.growth_params_init)
    return rated.withColumn("R2", F.round("R2", 9))


@register("a11_r_squared_init", "SELECT * FROM rated")
def a11_init(m):
    return _rated(m)


@register(
    "a12_logistic_curve_init",
    f"""SELECT entity, i, round(t, 9) AS t, round({_AT.format(t="t")}, 9) AS y
FROM (SELECT g.*, CAST(i AS INTEGER) AS i, t_first + i * (t_last + 2 - t_first) / 99 AS t
      FROM gparams g JOIN facts USING (entity), range(100) steps(i)) g""",
)
def a12_init(m):
    curve = curvefit.logistic_curve(m.growth_sequence, m.growth_params_init, m.p.curve_points)
    return curve.select("entity", "i", F.round("t", 9).alias("t"), F.round("y", 9).alias("y"))


@register(
    "a13_fit_quality_init",
    """SELECT entity, n, R2, reason = 'ok' AS ok, reason FROM (
  SELECT entity, n, R2, if(n < 8, 'too_few_points', if(R2 < 0.65, 'poor_fit', if(K / y_max < 1.05, 'no_headroom',
         if(y_max = y_min, 'flat', if(CAST(y_last AS DOUBLE) / y_max < 0.5, 'below_half_peak', 'ok'))))) AS reason
  FROM rated JOIN facts USING (entity)) checked""",
)
def a13_init(m):
    return curvefit.fit_quality(m.growth_sequence, _rated(m))


@register(
    "a14_headroom_init",
    """SELECT entity, greatest(K - y_last, 0.0) AS headroom, if(t0 < t_last, 'mature', 'takeoff') AS phase
FROM gparams JOIN facts USING (entity)""",
)
def a14_init(m):
    return curvefit.headroom(m.growth_sequence, m.growth_params_init)


@register("a15_export_params_init", "SELECT * FROM rated")
def a15_init(m):
    return sinks.export_csv(_rated(m), shared_path(m.spark, "exports", "scurve_params_init", unique=True))


# --- A47-A51 ----------------------------------------------------------------------
def _cells(m):
    """The ones of the incidence matrix: all users, or the top n if the parameters say so."""
    ev = S.cluster_events(m.ia)
    if m.p.cluster_max_users:
        ev = S.top_active_users(ev, m.p.cluster_max_users)
    return m.__dict__.setdefault("_cell_cache", m._keep(segments.incidence_cells(ev)))


def _segments(m):
    if "_seg_cache" not in m.__dict__:
        vec = m._keep(segments.incidence_vectors(_cells(m)))
        m.__dict__["_seg_cache"] = m._keep(segments.kmeans_segments(vec, m.p.cluster_k, m.p.cluster_seed, m.p.cluster_max_iter))
    return m.__dict__["_seg_cache"]


oracle._cte("ones", "SELECT uid, entity FROM pm WHERE entity <> -3 GROUP BY ALL")


@register(
    "a47_incidence_matrix",
    """SELECT uid, entity, idx FROM ones JOIN (
  SELECT entity, CAST(row_number() OVER (ORDER BY entity) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT entity FROM ones) e) i USING (entity)""",
)
def a47(m):
    return segments.incidence_matrix(_cells(m))


@register("a48_kmeans_segments", None)
def a48(m):
    return _segments(m)


@register("a49_pca_2d", None)
def a49(m):
    return segments.pca_2d(_cells(m))


@register("a50_cluster_profile", None)
def a50(m):
    return segments.cluster_profile(_segments(m), _cells(m))


@register("a51_cluster_diversity", None)
def a51(m):
    return segments.cluster_diversity(_segments(m))


# the same readings of a grouping that SQL can express: users by their modal label
oracle._cte("label_cells", """
SELECT c.cluster, e.entity, CAST(coalesce(users, 0) AS DOUBLE) / CAST(size AS DOUBLE) AS mean
FROM (SELECT CAST(global_label AS BIGINT) AS cluster, count(*) AS size FROM modal GROUP BY ALL) c
JOIN (SELECT DISTINCT entity FROM ones) e ON true
LEFT JOIN (SELECT CAST(global_label AS BIGINT) AS cluster, entity, count(*) AS users FROM ones JOIN modal USING (uid) GROUP BY ALL) h
  ON h.cluster = c.cluster AND h.entity = e.entity
""")


def _labelled(m):
    return m.user_modal_label.select("uid", F.col("global_label").cast("long").alias("cluster"))


@register(
    "a50_cluster_profile_labels",
    """SELECT cluster, entity, mean, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, entity) AS rank FROM label_cells) r WHERE rank <= 5""",
)
def a50_labels(m):
    return segments.cluster_profile(_labelled(m), _cells(m))


@register(
    "a51_cluster_diversity_labels",
    "SELECT clusters, if(clusters > 3, 'diverse', 'narrow') AS band FROM (SELECT count(DISTINCT global_label) AS clusters FROM modal) n",
)
def a51_labels(m):
    return segments.cluster_diversity(_labelled(m))


# --- A54 / T01-T04 ----------------------------------------------------------------
SPLIT_TS = "2024-01-16 00:00:00"

_F3_LOG = f"SELECT uid, entity, ts FROM ev WHERE ts < TIMESTAMP '{SPLIT_TS}'"
_F3_FEED = "SELECT uid, entity, epoch_ms(epoch_us(ts) // 1000) AS ts FROM ev"


def _log_and_batch(spark, sf_dir):
    ia = FIXTURES["f3"](spark, sf_dir)
    return ia.filter(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")), ia


@register_raw(
    "a54_incremental_append",
    oracle.sql(
        f"""{_F3_LOG}
UNION ALL
SELECT b.uid, b.entity, b.ts FROM ev b
WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.ts < TIMESTAMP '{SPLIT_TS}' AND o.uid = b.uid AND o.ts = b.ts AND o.entity = b.entity)""",
        "f3",
    ),
)
def a54(spark, sf_dir):
    """Initial log = events before the split; the pull returns every event again."""
    log, batch = _log_and_batch(spark, sf_dir)
    path = shared_path(spark, "logs", "interactions", unique=True)
    ingest.incremental_append(spark, path, log)
    ingest.incremental_append(spark, path, batch)
    return ingest.read_log(spark, path)


@register_raw("t02_land_feed", oracle.sql(_F3_FEED, "f3"))
def t02(spark, sf_dir):
    landing = shared_path(spark, "landing", "feed", unique=True)
    ingest.render_feed(FIXTURES["f3"](spark, sf_dir)).write.mode("overwrite").json(landing)
    return ingest.parse_feed(spark.read.schema(ingest.FEED_SCHEMA).json(landing))


@register_raw(
    "t03_stream_append",
    oracle.sql(
        f"""{_F3_LOG}
UNION ALL
SELECT f.uid, f.entity, f.ts FROM (SELECT DISTINCT * FROM ({_F3_FEED}) x) f
WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.ts < TIMESTAMP '{SPLIT_TS}' AND o.uid = f.uid AND o.ts = f.ts AND o.entity = f.entity)""",
        "f3",
    ),
)
def t03(spark, sf_dir):
    log, full = _log_and_batch(spark, sf_dir)
    base = shared_path(spark, "streams", "append", unique=True)
    landing, log_path, ckpt = (os.path.join(base, p) for p in ("landing", "log", "_checkpoint"))
    ingest.incremental_append(spark, log_path, log)
    ingest.render_feed(full).write.mode("overwrite").json(landing)
    stream_append(spark, landing, log_path, ckpt)
    return ingest.read_log(spark, log_path)


@register_raw("t04_stream_daily_type", oracle.sql("SELECT * FROM dtype", "f3"))
def t04(spark, sf_dir):
    src = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(src).schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )
    rows = stream.select(
        F.col("user_id").cast("bigint").alias("uid"),
        F.create_map(*[x for k, v in sorted(_EVENT_TYPES.items()) for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
        .cast("bigint")
        .alias("entity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )
    base = shared_path(spark, "streams", "daily_type", unique=True)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    run_daily_type(spark, rows, out, ckpt)
    return read_daily_type(spark, out)



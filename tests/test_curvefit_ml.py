"""Curve fit on planted series; clustering structure; streaming = batch; ingestion idempotence."""

import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from fanlens.operators import curvefit, ingest, segments
from fanlens.plans.registry import load_all
from fanlens.session import shared_path


def test_lm_recovers_planted_logistic():
    t = np.arange(30, dtype=float)
    y = 500.0 / (1 + np.exp(-0.4 * (t - 12.0)))
    got = curvefit.fit_logistic_lm(t, y, (y.max() * 1.2, 0.3, len(t) / 2))
    assert got[1] and np.allclose(got[0], (500.0, 0.4, 12.0), rtol=1e-4)


def test_fit_is_stable_over_tolerances_and_keeps_every_entity(spark):
    from fanlens.operators import growth
    from fanlens.plans.model import model_for

    m = model_for(spark, SF_MID)
    seq = growth.cumulative_acquisitions(m.acquisition)
    fit = curvefit.logistic_fit(seq).collect()
    assert len(fit) == 25 and all(r["converged"] for r in fit)
    pdf = seq.toPandas()
    for r in fit:
        own = pdf[pdf["entity"] == r["entity"]].sort_values("seq")
        t, y = own["seq"].to_numpy(float), own["mau"].to_numpy(float)
        for tol in (1e-6, 1e-10):
            p, _ = curvefit.fit_logistic_lm(t, y, (y.max() * 1.2, 0.3, len(t) / 2.0), tol=tol)
            assert np.allclose(p, (r["K"], r["r"], r["t0"]), rtol=1e-2)
    assert curvefit.logistic_fit(m.growth_sequence).count() == 25


def test_grouped_fit_and_r2_on_spark(spark):
    rows = []
    for ent, (k, r, t0) in {1: (300.0, 0.5, 10.0), 2: (80.0, 0.25, 15.0)}.items():
        for s in range(25):
            rows.append((ent, s, float(k / (1 + np.exp(-r * (s - t0))))))
    seq = spark.createDataFrame(rows, "entity long, seq long, mau double")
    fit = curvefit.r_squared(seq, curvefit.logistic_fit(seq))
    got = {r["entity"]: r for r in fit.collect()}
    assert abs(got[1]["K"] - 300) < 1e-3 and abs(got[2]["t0"] - 15) < 1e-3
    assert all(r["R2"] > 0.999999 for r in got.values())
    q = {r["entity"]: r["reason"] for r in curvefit.fit_quality(seq, fit).collect()}
    assert set(q.values()) <= {"ok", "no_headroom", "below_half_peak", "poor_fit", "flat", "too_few_points"}
    curve = curvefit.logistic_curve(seq, fit, 100)
    assert curve.count() == 200


def test_kmeans_on_planted_blocks(spark):
    ev = spark.createDataFrame(
        [(u, e) for u in range(40) for e in ((1, 2) if u < 20 else (3, 4))], "uid long, entity long"
    )
    cells = segments.incidence_cells(ev)
    vec = segments.incidence_vectors(cells)
    assert vec.first()["features"].size == 4
    seg = segments.kmeans_segments(vec, k=2, seed=42)
    groups = {tuple(sorted(r["uids"])) for r in seg.groupBy("cluster").agg(F.collect_list("uid").alias("uids")).collect()}
    assert groups == {tuple(range(20)), tuple(range(20, 40))}
    prof = segments.cluster_profile(seg, cells, 3).collect()
    assert sorted((r["entity"], r["mean"]) for r in prof) == [(1, 0.0), (1, 1.0), (2, 1.0), (3, 0.0), (3, 1.0), (4, 1.0)]
    assert segments.pca_2d(cells).count() == 40


def test_pca_equals_svd_of_the_centred_matrix(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((120, 8)) < np.array([0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1])).astype(float)
    a[:60, :3] = 0
    a[:, 0] = np.maximum(a[:, 0], a.sum(axis=1) == 0)
    cells = spark.createDataFrame([(int(u), int(e)) for u, e in zip(*np.nonzero(a))], "uid long, entity long")
    got = segments.pca_2d(cells, iterations=60).toPandas().sort_values("uid")[["x", "y"]].to_numpy()
    u, s, _ = np.linalg.svd(a - a.mean(axis=0))
    want = u[:, :2] * s[:2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)


def test_registered_pca_equals_svd_of_the_given_log(spark):
    from fanlens.plans.model import model_for

    m = model_for(spark, SF_MID)
    got = load_all()["a49_pca_2d"].on_model(m).toPandas().sort_values("uid")[["x", "y"]].to_numpy()
    cells = segments.incidence_cells(m.ia).toPandas()
    (_, u), (_, e) = (np.unique(cells[k], return_inverse=True) for k in ("uid", "entity"))
    a = np.zeros((u.max() + 1, e.max() + 1))
    a[u, e] = 1.0
    left, s, right = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    sign = np.sign(right[[0, 1], np.abs(right[:2]).argmax(axis=1)])
    assert np.allclose(got, left[:, :2] * s[:2] * sign, atol=1e-6)


def test_pca_of_more_entities_than_it_holds_vectors(spark, monkeypatch):
    monkeypatch.setattr(segments, "PCA_BLOCK", 4)
    monkeypatch.setattr(segments, "PCA_WIDTH", 16)
    rng = np.random.default_rng(7)
    a = (rng.random((100, 22)) < 0.3).astype(float)  # a flat spectrum
    cells = spark.createDataFrame([(int(u), int(e)) for u, e in zip(*np.nonzero(a))], "uid long, entity long")
    got = segments.pca_2d(cells).toPandas().sort_values("uid")[["x", "y"]].to_numpy()
    u, s, _ = np.linalg.svd(a - a.mean(axis=0))
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-5)
    assert segments.pca_2d(cells.limit(0)).count() == 0
    one = segments.pca_2d(cells.where("entity = 0")).collect()
    assert one and all((r["x"], r["y"]) == (0.0, 0.0) for r in one)


def test_clustering_covers_all_users(spark):
    from fanlens.plans.model import model_for

    reg = load_all()
    m = model_for(spark, SF_SMALL)
    users = m.ia.select("uid").distinct().count()
    assert reg["a48_kmeans_segments"].on_model(m).count() == users
    assert reg["a49_pca_2d"].on_model(m).count() == users


def test_late_files_equal_the_batch(spark, tmp_path):
    from fanlens.streaming.daily import read_daily_type, run_daily_type

    src = str(tmp_path / "in")
    for k, day in enumerate((20, 25, 1)):
        one = spark.sql(f"SELECT CAST({k} AS BIGINT) AS uid, CAST(1 AS BIGINT) AS entity, timestamp_ntz'2024-01-{day:02d} 05:00:00' AS ts")
        one.coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_daily_type(spark, rows, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = read_daily_type(spark, str(tmp_path / "out")).collect()
    assert sorted((r["day"].day, r["total"]) for r in got) == [(1, 1), (20, 1), (25, 1)]


def test_append_reads_only_the_months_of_the_batch(spark):
    log = spark.createDataFrame([], ingest.LOG_SCHEMA)
    path = shared_path(spark, "tests", "pruned", unique=True)
    row = "SELECT CAST(1 AS BIGINT) AS uid, CAST(2 AS BIGINT) AS entity, timestamp_ntz'2024-0{}-05 05:00:00' AS ts"
    for month in (1, 2, 3):
        ingest.incremental_append(spark, path, spark.sql(row.format(month)))
    log = spark.read.schema(ingest.LOG_SCHEMA).parquet(path)
    plan = ingest.new_rows(log, spark.sql(row.format(2)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*2024-02-01", plan) and "2024-03" not in plan
    assert ingest.incremental_append(spark, path, spark.sql(row.format(2))) == 0


def test_unreadable_log_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ingest.incremental_append(spark, str(tmp_path / "log"), spark.sql("SELECT CAST(1 AS BIGINT) AS uid, CAST(2 AS BIGINT) AS entity, timestamp_ntz'2024-01-05 05:00:00' AS ts"))


def test_append_twice_equals_once_and_empty_is_noop(spark):
    reg = load_all()
    from fanlens.sources.interactions import FIXTURES

    ia = FIXTURES["f3"](spark, SF_SMALL)
    path = shared_path(spark, "tests", "log", unique=True)
    assert ingest.incremental_append(spark, path, ia) == ia.count()
    assert ingest.incremental_append(spark, path, ia) == 0
    assert ingest.incremental_append(spark, path, ia.limit(0)) == 0
    assert ingest.read_log(spark, path).count() == ia.count()
    assert "a54_incremental_append" in reg


def test_streams_equal_batch(spark):
    reg = load_all()
    stream = reg["t04_stream_daily_type"].build(spark, SF_SMALL)
    batch = reg["d24_daily_type"].on_model
    from fanlens.plans.model import model_for

    want = model_for(spark, SF_SMALL, "f3").daily_type
    assert sorted(stream.collect()) == sorted(want.select("day", "weak", "strong", "total").collect())
    assert batch is not None
    landed = reg["t02_land_feed"].build(spark, SF_SMALL)
    assert landed.count() == model_for(spark, SF_SMALL, "f3").ia.count()


def test_time_helpers_ignore_session_zone(spark):
    from fanlens.functions.time import as_utc_instant, epoch_millis, to_event_time, utc_wallclock

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS ts").select(
                epoch_millis("ts").alias("ms"), utc_wallclock(as_utc_instant("ts")).alias("back"),
                to_event_time(F.lit(1704067200000)).alias("ev"),
            ).first()
            assert r["ms"] == 1710037800123
            assert str(r["back"]) == "2024-03-10 02:30:00.123456"
            assert str(r["ev"]) == "2024-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_mid_scale_model_has_all_relations(spark):
    from fanlens.plans.model import model_for

    m = model_for(spark, SF_MID)
    assert m.first_touch.count() == 26543

"""Logistic growth fit per entity.

The fit is the only place that needs imperative numerics: a Levenberg-Marquardt
least-squares solve of K / (1 + exp(-r (t - t0))) on one entity's monthly
series.  It runs as a grouped-map pandas function (``applyInPandas``): one group
is one entity's series, which is bounded by the number of observed months.
Everything around it (R², curve points, quality checks, headroom) is plain
Spark column work on the fitted parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.functions.math import logistic
from fanlens.params import Params

FIT_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.LongType()),
        T.StructField("K", T.DoubleType()),
        T.StructField("r", T.DoubleType()),
        T.StructField("t0", T.DoubleType()),
        T.StructField("converged", T.BooleanType()),
    ]
)


def _model(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, r, t0 = p
    z = np.clip(-r * (t - t0), -700.0, 700.0)
    e = np.exp(z)
    f = k / (1.0 + e)
    d = (1.0 + e) ** 2
    jac = np.column_stack([1.0 / (1.0 + e), k * e * (t - t0) / d, -k * e * r / d])
    return f, jac


def fit_logistic_lm(t: np.ndarray, y: np.ndarray, p0, max_evals: int = 5000, tol: float = 1.49e-8):
    """Levenberg-Marquardt: ((K, r, t0), converged).

    Converged: a step changed the squared error, or every parameter, by no more than
    ``tol`` of itself.  A fit that stalls or runs out of evaluations keeps its best point."""
    p = np.asarray(p0, dtype=float)
    f, jac = _model(t, p)
    res = y - f
    sse = float(res @ res)
    lam = 1e-3
    evals = 1
    while evals < max_evals:
        a = jac.T @ jac
        g = jac.T @ res
        step_ok = False
        while evals < max_evals:
            try:
                delta = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g)
            except np.linalg.LinAlgError:
                return tuple(float(v) for v in p), False
            cand = p + delta
            f2, jac2 = _model(t, cand)
            evals += 1
            res2 = y - f2
            sse2 = float(res2 @ res2)
            if np.isfinite(sse2) and sse2 <= sse:
                rel = (sse - sse2) / max(sse, 1e-300)
                small = np.max(np.abs(delta) / (np.abs(p) + 1e-12)) < tol
                p, jac, res, sse = cand, jac2, res2, sse2
                lam = max(lam / 10.0, 1e-12)
                step_ok = True
                if rel < tol or small or sse == 0.0:
                    return tuple(float(v) for v in p), True
                break
            lam *= 10.0
            if lam > 1e16:  # no downhill step is left
                return tuple(float(v) for v in p), bool(np.max(np.abs(g)) <= tol * max(sse, 1.0))
        if not step_ok:
            break
    return tuple(float(v) for v in p), False


def logistic_fit(seq: DataFrame, p: Params = Params()) -> DataFrame:
    """A10: (entity, K, r, t0, converged) for entities with >= min_points observed months."""
    min_points, r0, max_evals, tol = p.growth_min_points, p.fit_r_init, p.fit_max_evals, p.fit_tolerance

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        t = pdf["seq"].to_numpy(dtype=float)
        y = pdf["mau"].to_numpy(dtype=float)
        if len(t) < min_points:
            return pd.DataFrame(columns=["entity", "K", "r", "t0", "converged"])
        (k, r, t0), done = fit_logistic_lm(t, y, (y.max() * 1.2, r0, len(t) / 2.0), max_evals, tol)
        return pd.DataFrame([{"entity": int(pdf["entity"].iloc[0]), "K": k, "r": r, "t0": t0, "converged": done}])

    return seq.select("entity", "seq", "mau").groupBy("entity").applyInPandas(fit, FIT_SCHEMA)


def r_squared(seq: DataFrame, params: DataFrame) -> DataFrame:
    """1 - SSE/SST per entity (0 when SST = 0), as a Spark aggregation."""
    pred = logistic(F.col("seq").cast("double"), F.col("K"), F.col("r"), F.col("t0"))
    mean = F.avg("mau").over(Window.partitionBy("entity"))
    x = seq.join(params, "entity").select(
        "entity", "K", "r", "t0",
        F.pow(F.col("mau") - pred, 2).alias("se"),
        F.pow(F.col("mau") - mean, 2).alias("st"),
    )
    g = x.groupBy("entity", "K", "r", "t0").agg(F.sum("se").alias("sse"), F.sum("st").alias("sst"))
    return g.select("entity", "K", "r", "t0", F.when(F.col("sst") != 0, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(0.0)).alias("R2"))


def logistic_curve(seq: DataFrame, params: DataFrame, n: int = 100) -> DataFrame:
    """``n`` evenly spaced points on [t_min, t_max + 2] of each fitted curve."""
    span = seq.groupBy("entity").agg(F.min("seq").alias("t_min"), F.max("seq").alias("t_max"))
    x = span.join(params, "entity").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("t_min") + F.col("i") * (F.col("t_max") + 2 - F.col("t_min")) / F.lit(n - 1)
    return x.select("entity", "i", t.alias("t")).join(params, "entity").select(
        "entity", "i", "t", logistic(F.col("t"), F.col("K"), F.col("r"), F.col("t0")).alias("y")
    )


def _series_facts(seq: DataFrame) -> DataFrame:
    return seq.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("mau").alias("y_max"),
        F.min("mau").alias("y_min"),
        F.max_by("mau", "seq").alias("y_last"),
        F.max("seq").alias("t_last"),
    )


def fit_quality(seq: DataFrame, fit: DataFrame) -> DataFrame:
    """Five ordered checks -> (ok, reason)."""
    x = _series_facts(seq).join(fit, "entity")
    reason = (
        F.when(F.col("n") < 8, "too_few_points")
        .when(F.col("R2") < 0.65, "poor_fit")
        .when(F.col("K") / F.col("y_max") < 1.05, "no_headroom")
        .when(F.col("y_max") == F.col("y_min"), "flat")
        .when(F.col("y_last") / F.col("y_max") < 0.5, "below_half_peak")
        .otherwise("ok")
    )
    return x.select("entity", "n", "R2", (reason == "ok").alias("ok"), reason.alias("reason"))


def headroom(seq: DataFrame, fit: DataFrame) -> DataFrame:
    """Room to the ceiling and the phase (mature once the last t passed t0)."""
    x = _series_facts(seq).join(fit, "entity")
    return x.select(
        "entity",
        F.greatest(F.lit(0.0), F.col("K") - F.col("y_last")).alias("headroom"),
        F.when(F.col("t_last") > F.col("t0"), "mature").otherwise("takeoff").alias("phase"),
    )

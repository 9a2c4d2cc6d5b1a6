"""User clustering on the uid x entity incidence matrix.

The matrix is kept as its cells, one row a (uid, entity); only K-means gets
vectors, sparse ones that the JVM builds from each user's entities.  The number of users is the caller's choice
(``selection.top_active_users``); nothing here has a limit of its own, and no
n x n matrix, dense row or single-task index is built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.functions.joins import join_per_entity
from fanlens.functions.ranks import numbered
from fanlens.params import CLUSTER_K_RANGE, Params, check_range
from fanlens.session import ensure_checkpoint_dir

PCA_BLOCK, PCA_WIDTH = 8, 64  # vectors a round adds, and holds


def incidence_cells(ev: DataFrame) -> DataFrame:
    """The ones of the matrix: distinct (uid, entity)."""
    return ev.select("uid", "entity").distinct()


def entity_index(cells: DataFrame) -> DataFrame:
    """Dense 0-based column of every entity present, in id order."""
    return numbered(cells.select("entity").distinct(), "entity", "idx").select("entity", F.col("idx").cast("int").alias("idx"))


def incidence_matrix(cells: DataFrame) -> DataFrame:
    """(uid, entity, idx), a row for each one of the matrix."""
    return join_per_entity(cells, entity_index(cells)).select("uid", "entity", "idx")


def incidence_vectors(cells: DataFrame) -> DataFrame:
    """(uid, features): sparse binary rows, columns in id order.

    The vectoriser's vocabulary is the list of entities, as long as a K-means centre."""
    seen = cells.groupBy("entity").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.count_if(F.col("uid").isNull()).alias("none")).collect()
    vocabulary = [str(e) for e in sorted(r["entity"] for r in seen if r["entity"] is not None)]
    users = {u for r in seen for u in (r["lo"], r["hi"]) if u is not None} | {None for r in seen if r["none"]}  # two, if there are two
    if len(vocabulary) < 2 or len(users) < 2:
        raise ValueError("clustering needs at least a 2 x 2 incidence matrix")
    rows = cells.groupBy("uid").agg(F.collect_set(F.col("entity").cast("string")).alias("entities"))
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="entities", outputCol="features", binary=True)
    return model.transform(rows).select("uid", "features")


def kmeans_segments(vec: DataFrame, k: int = 4, seed: int = 42, max_iter: int = Params.cluster_max_iter) -> DataFrame:
    """(uid, cluster)."""
    check_range("k", k, *CLUSTER_K_RANGE)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(vec)
    return model.transform(vec).select("uid", F.col("cluster").cast("long").alias("cluster"))


def _gram(rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of (``s`` of all rows) x ``of``.

    Each partition's matrix is cut into its numbers, which Spark adds up: the driver
    gets one number a pair of columns, however many partitions there are."""
    d = of.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["s"].to_numpy()) @ of
                total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel()]})

    parts = rows.select("s").mapInPandas(run, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(d * d)
    out[sums["at"].to_numpy()] = sums["x"].to_numpy()
    return out.reshape(d, d)


def _mixed(rows: DataFrame, of: np.ndarray) -> DataFrame:
    """entity, ``s`` x ``of``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            s = list(np.stack(pdf["s"].to_numpy()) @ of) if len(pdf) else []
            yield pd.DataFrame({"entity": pdf["entity"], "s": pd.Series(s, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, rows.schema)


def pca_2d(cells: DataFrame, iterations: int | None = None, tol: float = 1e-9) -> DataFrame:
    """First two principal components of the centred matrix -> (uid, x, y).

    Block Davidson iteration on the cells: a user's score is the sum of its entities'
    loadings less the mean score, a loading the sum of its users' scores; the mean
    is subtracted as a number, so zeros stay absent.  Up to ``PCA_WIDTH`` orthonormal
    vectors and their products are kept by entity, the best pairs taken from the
    small matrix of their sums, and widened by their residuals until both components'
    residuals are below ``tol`` of the first eigenvalue (or of rounding); it is an error
    if they do not halve in 50 rounds.  The driver sees these sums only.  ``iterations`` ends it after so many rounds, converged or
    not; the default has no such end.  Each component's largest loading is positive."""
    ensure_checkpoint_dir(cells.sparkSession)
    cells = cells.persist()
    users = max(cells.select("uid").distinct().count(), 1)
    seed = lambda s: F.pmod(F.xxhash64("entity", F.lit(s)), F.lit(1 << 20)) / (1 << 20) - 0.5
    held = cells.where("entity IS NOT NULL").groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = held.select("entity", F.array("n", *[seed(k + 1) for k in range(PCA_BLOCK)]).alias("s")).checkpoint()
    m = 0  # vectors; a row's ``s`` x ``to`` is its number of users, the vectors and their products
    to, to_w = np.eye(1 + PCA_BLOCK)[:, :1], np.eye(1 + PCA_BLOCK)[:, 1:]  # ``s`` x ``to_w`` are the new vectors
    best, value, scale, done, least = np.zeros((0, 0)), None, 0.0, 0, (math.inf, 0)
    while True:
        for again in (False, True):  # the second time takes off what rounding left
            sums = _gram(rows, np.hstack((to[:, 1 : m + 1], to_w)))
            inside, size = sums[:m, m:], sums[m:, m:]
            long = np.sqrt(np.diag(size))
            if value is not None and not again:  # they are residuals
                enough = max(tol * value[0], 1e-12 * math.sqrt(scale))
                if (long[:2] <= enough).all() or done == iterations:
                    to_w = to_w[:, :0]
                    break
                least = min(least, (long[:2].max() / 2, done)) if long[:2].max() <= least[0] else least
                if done > least[1] + 50:
                    raise RuntimeError(f"components do not converge: residuals {long[:2]}, wanted {enough}")
                long = np.where(long <= enough, np.inf, long)
            unit = 1 / np.maximum(long, 1e-300)
            spread, mix = np.linalg.eigh(unit[:, None] * (size - inside.T @ inside) * unit)
            mix = unit[:, None] * mix[:, spread > 1e-10] / np.sqrt(spread[spread > 1e-10])
            to_w = to_w @ mix - to[:, 1 : m + 1] @ (inside @ mix)
        b = to_w.shape[1]
        if not b:
            break  # converged, or the vectors span all entities
        fresh = _mixed(rows, np.hstack((to, to_w))).checkpoint()
        w = fresh.select("entity", *[F.element_at("s", k - b).alias(f"w{k}") for k in range(b)])
        by_user = join_per_entity(cells, w).groupBy("uid").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(b)])
        product = cells.join(by_user, "uid").groupBy("entity").agg(F.array(*[F.sum(f"w{k}") for k in range(b)]).alias("p"))
        rows = fresh.join(product, "entity").select("entity", F.concat("s", "p").alias("s")).checkpoint()
        # ``s`` is now n, the old vectors and products, the new vectors and their products without the mean
        e = np.eye(1 + 2 * m + 2 * b)
        sums = _gram(rows, e)
        old_v, old_c, own, raw = (np.arange(x, x + k) for x, k in ((1, m), (1 + m, m), (1 + 2 * m, b), (1 + 2 * m + b, b)))
        mean = sums[0, own] / users
        scale = max(scale, np.trace(sums[np.ix_(raw, raw)]))
        to = np.hstack((e[:, :1], e[:, old_v], e[:, own], e[:, old_c], e[:, raw] - np.outer(e[:, 0], mean)))
        m, done = m + b, done + 1
        half = np.linalg.inv(np.linalg.cholesky(to[:, 1 : m + 1].T @ sums @ to[:, 1 : m + 1]))  # near the unit matrix
        h = half @ (to[:, 1 : m + 1].T @ sums @ to[:, m + 1 :]) @ half.T
        value, best = np.linalg.eigh((h + h.T) / 2)
        value, best = value[::-1], half.T @ best[:, ::-1]
        if m + PCA_BLOCK > PCA_WIDTH:  # begin again from the best
            keep = best[:, : 2 * PCA_BLOCK]
            to = np.hstack((to[:, :1], to[:, 1 : m + 1] @ keep, to[:, m + 1 :] @ keep))
            m = keep.shape[1]
            best = np.eye(m)
        k = min(PCA_BLOCK, m)
        to_w = to[:, m + 1 :] @ best[:, :k] - to[:, 1 : m + 1] @ best[:, :k] * value[:k]

    two = np.zeros((to.shape[0], 2))
    two[:, : min(m, 2)] = to[:, 1 : m + 1] @ best[:, :2]
    mean = _gram(rows, np.hstack((to[:, :1], two)))[0, 1:] / users
    load = _mixed(rows, two).select("entity", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).checkpoint()
    sign = load.agg(*[F.signum(F.max_by(k, F.struct(F.abs(F.col(k)), -F.col("entity")))) for k in ("a", "b")]).first()
    raw = join_per_entity(cells, load).groupBy("uid").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return raw.select("uid", *[((F.col(k) - float(x)) * (s or 1.0)).alias(name) for k, x, s, name in zip(("a", "b"), mean, sign, ("x", "y"))])


def cluster_profile(seg: DataFrame, cells: DataFrame, top: int = 5) -> DataFrame:
    """Per cluster the ``top`` entities by mean incidence (ties -> smaller id), means of zero included."""
    size = seg.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    held = cells.join(seg.select("uid", "cluster"), "uid").groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("users"))
    # a cluster of fewer than ``top`` entities is filled up with the smallest ids it does not hold
    least = cells.select("entity").distinct().orderBy("entity").limit(2 * top).agg(F.collect_list("entity").alias("ids"))  # one row
    blank = size.select("cluster").join(F.broadcast(least)).select("cluster", F.explode("ids").alias("entity"), F.lit(0).cast("long").alias("users"))
    every = held.unionByName(blank).groupBy("cluster", "entity").agg(F.max("users").alias("users"))
    mean = every.join(size, "cluster").select("cluster", "entity", (F.col("users") / F.col("size")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("mean").desc(), F.col("entity")))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= top)


def cluster_diversity(seg: DataFrame) -> DataFrame:
    """Number of clusters found; band <= 3."""
    return seg.agg(F.countDistinct("cluster").alias("clusters")).withColumn(
        "band", F.when(F.col("clusters") <= 3, "narrow").otherwise("diverse")
    )

"""Approximate nearest neighbours by learned partitions.

Fit, on the driver, from a sample of at most ``SAMPLE_ROWS`` vectors (those with
the smallest hashes of their ids): the sample's neighbour graph is cut into
equal parts by recursive bisection (the median of the graph's second
eigenvector, then swaps that cut fewer edges), and a small network learns the
parts of each vector's neighbours.  The model is a few matrices whose size the
parameters bound.

Index: every vector goes to its most probable part.  A query goes to as many
of its most probable parts as hold the share ``MASS`` of its neighbours by the
model, and is compared there with every vector, in double precision.  Parts are cut into blocks of ``BLOCK_ROWS`` vectors and queries into
blocks too, so a part with a third of all vectors is many small tasks; each
block pair returns a query's best k only.  Nothing is dropped from a part.

Scores are recomputed from the original vectors for all candidates within
rounding of the k best, so ties are exact and go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id.  Vectors are compared only
with those of equal length; each length has an index of its own.  Rows that
share an id count as one, the smallest vector.  Fewer candidates than k: all of
the probed parts.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.llm.common import durable

SAMPLE_ROWS = 8_192
PART_ROWS = 125  # vectors a part should have; at most SAMPLE_ROWS / 64 parts
NEIGHBOURS, HIDDEN, EPOCHS, SEED = 12, 128, 15, 5
MASS = 0.96  # probability of the parts that a query visits, taken together
BLOCK_ROWS, QUERY_ROWS = 8_192, 2_048
NEAR = 1e-9  # by which blocked and row-wise products may differ


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest inner products with other rows."""
    x, out = x.astype(np.float32), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(u: np.ndarray, v: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two equal halves (bool) of nodes 0..n-1 that cut few of the edges u - v."""
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    root = np.sqrt(np.maximum(degree, 1))
    trivial = root / np.linalg.norm(root)
    y = rng.standard_normal(n)
    for _ in range(60):  # power iteration for the second eigenvector of the normalised graph
        y -= trivial * (trivial @ y)
        z = y / root
        y = y + (np.bincount(u, z[v], n) + np.bincount(v, z[u], n)) / root
        y /= np.linalg.norm(y)
    side = np.zeros(n, bool)
    side[np.argsort(y, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swap the nodes that lose most edges by staying
        across = side[u] != side[v]
        gain = np.bincount(u, across, n) + np.bincount(v, across, n)
        gain = 2 * gain - degree
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int(np.sum(gain[left[:m]] + gain[right[:m]] > 2))
        if not good:
            break
        good = max(1, good // 2)
        swapped = side.copy()
        swapped[left[:good]], swapped[right[:good]] = True, False
        if (swapped[u] != swapped[v]).sum() >= across.sum():
            break
        side = swapped
    return side


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node: ``parts`` (a power of two) equal ones."""
    n, k = graph.shape
    u, v = np.repeat(np.arange(n), k), graph.ravel()
    label = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        split = np.zeros(n, np.int64)
        for p in range(count):
            own = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[u] >= 0) & (place[v] >= 0)
            split[own] = bisect(place[u[inside]], place[v[inside]], len(own), rng)
        label = label * 2 + split
        count *= 2
    return label


class Router:
    """A network with one hidden layer: probabilities of the parts of a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator):
        self.scale = np.sqrt(np.mean(x**2)) or 1.0
        dims, parts = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((dims, HIDDEN)) * np.sqrt(2 / dims), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        m, s = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                xb = x[rows] / self.scale
                hidden = np.maximum(xb @ self.w[0] + self.w[1], 0)
                wrong = (_softmax(hidden @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (wrong @ self.w[2].T) * (hidden > 0)
                step += 1
                for i, g in enumerate((xb.T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0))):
                    m[i] += 0.1 * (g - m[i])
                    s[i] += 0.001 * (g * g - s[i])
                    self.w[i] -= 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)

    def parts(self, x: np.ndarray, mass: float) -> list[np.ndarray]:
        """The most probable parts of each row, as many as reach ``mass`` together (one for 0)."""
        share = _softmax(np.maximum(x / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])
        order = np.argsort(-share, axis=1, kind="stable").astype(np.int32)
        before = np.cumsum(np.take_along_axis(share, order, 1), axis=1) - np.take_along_axis(share, order, 1)
        return [row[: max(1, n)] for row, n in zip(order, (before < mass).sum(axis=1), strict=True)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int) -> Router | None:
    """A router for ``parts`` parts; None if one part is all there is."""
    if parts < 2:
        return None
    rng = np.random.default_rng(SEED)
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(x), parts))
    near = np.concatenate((np.arange(len(x))[:, None], graph), axis=1)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1 / near.shape[1])
    return Router(x, target, rng)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double), dims: the rows that take part, one for each id."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull()).where(fine)
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))


def _placed(router: Router | None, mass: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                yield pdf.assign(parts=router.parts(x, mass) if router else [np.zeros(1, np.int32)] * len(x))

    return run


def top_of_block(k: int):
    """Each query's k best candidates of a block pair; equal scores go to the smaller id."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            block = block.sort_values("id")
            ids, x, q = block["id"].to_numpy(), np.stack(block["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            rough = q @ x.T
            for query, row, vec in zip(queries["id"], rough, q, strict=True):
                row[ids == query] = -np.inf
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    at = np.flatnonzero(row >= least - NEAR * max(1.0, abs(least)))
                else:
                    at = np.arange(len(row))
                at = at[ids[at] != query]
                score = (x[at] * vec).sum(axis=1)  # a row's sum does not depend on its place
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = PART_ROWS, mass: float = MASS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found among ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    every, asked = durable(usable(vectors, id_col, vec_col)), usable(queries, id_col, vec_col)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dims, n in sorted(tuple(r) for r in every.groupBy("dims").agg(F.count("*")).collect()):  # lengths in use: usually one
        mine = every.where(F.col("dims") == dims).select("id", "v")
        sample = mine.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
        x = np.stack(sample["v"].to_numpy())  # at most sample_rows vectors
        parts = 1 << max(0, int(np.log2(max(1, min(n / part_rows, len(x) / 64)))))
        router = fit(x, parts)
        schema = "id long, v array<double>, parts array<int>"
        rows = durable(mine.mapInPandas(_placed(router, 0.0), schema).select("id", "v", F.col("parts")[0].alias("part")))
        visits = asked.where(F.col("dims") == dims).select("id", "v").mapInPandas(_placed(router, mass), schema)
        visits = visits.select("id", "v", F.explode("parts").alias("part"))
        blocks = {r[0]: -(-r[1] // BLOCK_ROWS) for r in rows.groupBy("part").agg(F.count("*")).collect()}  # a number for each part
        if not blocks:
            continue
        visits = durable(visits)
        # a part's queries are dealt by their own number, however many visit it
        chunks = {r[0]: -(-r[1] // QUERY_ROWS) for r in visits.groupBy("part").agg(F.count("*")).collect()}
        of_part = lambda sizes: F.element_at(F.create_map(*[F.lit(z) for p, b in sizes.items() for z in (p, b)]), F.col("part"))
        if not chunks:
            continue
        many, dealt = of_part(blocks), of_part(chunks)
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = visits.where(many.isNotNull()).select("id", "v", "part", spread(many).alias("block"), F.pmod(F.xxhash64("id"), dealt).alias("chunk"))
        right = rows.where(dealt.isNotNull()).select("id", "v", "part", F.pmod(F.xxhash64("id"), many).alias("block"), spread(dealt).alias("chunk"))
        by = ["part", "block", "chunk"]
        left, right = left.withColumn("block", F.col("block").cast("long")), right.withColumn("chunk", F.col("chunk").cast("long"))
        got = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(top_of_block(k), found.schema)
        found = found.unionByName(got)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

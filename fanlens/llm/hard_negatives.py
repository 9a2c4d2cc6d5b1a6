"""Hard negatives by a vertical scan of columns (branch and bound on decomposed data).

Vectors become integers and lie in blocks of columns, one array a dimension.  An
anchor reads a block's columns in descending order of its own magnitudes; what
the unread dimensions can still add lies between the sums of their least and
largest contributions (from each column's minimum and maximum), and candidates
whose interval rules them out leave the bitmap of live rows.

There are two passes.  The first keeps the rows of the anchor's label that may be
among its best and gives the positives; their scores give windows of negative
scores.  The second keeps the rows of other labels that may lie in a window and be
among the best there.  Scores of the rows that are left are exact integers.

Rows are ordered by label and cut into blocks of ``BLOCK_ROWS``, anchors into
chunks of ``CHUNK_ROWS``; a task holds one block and one chunk, so a label with a
third of all rows is many tasks.  In the first pass blocks and chunks meet only
where they share a label.

Defined cases: rows with a null id or label, a null vector, or a null or
non-finite component take no part.  Rows that share an id count as one: the
smallest by label, then vector; it is an anchor if one of them is.  Vectors are
compared only with those of equal length.  Components and scores beyond a long are
cut to its ends; scores are computed exactly before that.  Ties go to the smaller
id.  Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.llm.common import durable, fresh, join_small, ranked

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
BLOCK_ROWS, CHUNK_ROWS = 8_192, 1_024
STEP = 8  # columns read between two prunings
LONG = 2**63 - 1


def matrix(table, name: str = "v") -> np.ndarray:
    """Rows of a list column of equal lengths, as int64."""
    lists = table[name].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.maximum(flat.reshape(len(lists), -1 if len(flat) else 0), -LONG)


def exact_type(left: np.ndarray, right: np.ndarray):
    """A type that holds every sum of products of rows of ``left`` and ``right`` exactly."""
    if not left.size or not right.size:
        return np.float64
    most = left.shape[1] * int(np.abs(left).max()) * int(np.abs(right).max())
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def kth_largest(x: np.ndarray, k: int):
    return np.sort(x)[len(x) - k] if x.dtype == object else np.partition(x, len(x) - k)[len(x) - k]


class Columns:
    """A block's columns with their least and largest values."""

    def __init__(self, rows: np.ndarray, kind):
        self.columns = np.ascontiguousarray(rows.T).astype(kind)
        self.least = self.columns.min(axis=1) if rows.size else np.zeros(rows.shape[1], kind)
        self.largest = self.columns.max(axis=1) if rows.size else np.zeros(rows.shape[1], kind)

    def scan(self, anchor: np.ndarray, live: np.ndarray, prune: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``live`` that ``prune(lower, upper)`` never dropped, and their exact scores."""
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        ends = np.stack((anchor * self.least, anchor * self.largest))[:, order]
        rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        score = np.zeros(len(live), self.columns.dtype)
        for at in range(0, len(order), STEP):
            if not len(live):
                break
            read = order[at : at + STEP]
            whole = len(live) == self.columns.shape[1]
            score = score + anchor[read] @ (self.columns[read] if whole else self.columns[read[:, None], live])
            after = min(at + STEP, len(order))
            keep = prune(score + rest_low[after], score + rest_high[after])
            live, score = live[keep], score[keep]
        return live, score


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _longs(x) -> list[int]:
    return [max(-LONG, min(LONG, int(v))) for v in x]


def may_be_best(k: int):
    """Keeps the rows that may be among the k best."""

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= kth_largest(lower, k) if len(lower) > k else np.ones(len(lower), bool)

    return prune


def may_be_best_between(windows: list[tuple[int, int]], k: int):
    """Keeps the rows that may be among the k best of a window of scores."""

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            floor = max(low, kth_largest(sure, k)) if len(sure) >= k else low
            keep |= (upper >= floor) & (lower <= high)
        return keep

    return prune


def _pair(anchors, rows):
    left, right = matrix(anchors), matrix(rows)
    kind = exact_type(left, right)
    return left.astype(kind), Columns(right, kind)


def positives_of(k: int):
    def run(anchors, rows):
        import pyarrow as pa

        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if anchors.num_rows and rows.num_rows:
            left, block = _pair(anchors, rows)
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            places = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
            for id_, label, vec in zip(anchors["id"].to_numpy(), anchors["label"].to_numpy(), left, strict=True):
                live = places.get(label, np.zeros(0, np.int64))
                live, score = block.scan(vec, live[ids[live] != id_], may_be_best(k))
                top = best(ids[live], score, k)
                out["anchor_id"] += [id_] * len(top)
                out["positive_id"] += ids[live[top]].tolist()
                out["positive_score"] += _longs(score[top])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def negatives_of(k: int):
    def run(anchors, rows):
        import pyarrow as pa

        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        out: dict[str, list] = {c: [] for c in names}
        if anchors.num_rows and rows.num_rows:
            left, block = _pair(anchors, rows)
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            asked = zip(anchors["id"].to_numpy(), anchors["label"].to_numpy(), left, anchors["windows"].to_pylist(), strict=True)
            for id_, label, vec, windows in asked:
                live, score = block.scan(vec, np.flatnonzero(labels != label), may_be_best_between([(w["low"], w["high"]) for w in windows], k))
                for w in windows:
                    inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                    top = inside[best(ids[live[inside]], score[inside], k)]
                    for c, v in zip(names, ([id_] * len(top), [w["positive_id"]] * len(top), [w["score"]] * len(top), ids[live[top]].tolist(), _longs(score[top])), strict=True):
                        out[c] += v
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def usable(vectors: DataFrame, anchor, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, label, anchor, v (array of long), dims: the rows that take part, one for each id."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("x"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("bigint"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", whole.alias("v"))).alias("r"), F.max("anchor").alias("anchor"))
    return rows.select("id", "r.label", "anchor", "r.v", F.size("r.v").alias("dims"))


def _every(n) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def mine(
    vectors: DataFrame, anchor, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (longs, rank int from 1).

    ``anchor`` (a condition) names the anchors.  Their positives are the ``positives``
    best rows of the same label; negatives are the ``negatives`` best rows of other
    labels from ``low`` to ``high`` per cent of the positive's score."""
    rows = ranked(usable(vectors, anchor, id_col, label_col, vec_col, scale), ["dims"], ["label", "id"], "place", "rows")
    rows = durable(rows.select("id", "label", "anchor", "v", "dims", F.expr(f"place div {block_rows}").alias("block"), F.ceil(F.col("rows") / block_rows).alias("blocks")))
    asked = ranked(rows.where("anchor").drop("anchor"), ["dims"], ["label", "id"], "place", "rows")
    asked = durable(asked.select("id", "label", "v", "dims", "blocks", F.expr(f"place div {chunk_rows}").alias("chunk"), F.ceil(F.col("rows") / chunk_rows).alias("chunks")))
    rows = rows.drop("anchor", "blocks")
    # where a label's rows and anchors lie
    spans = rows.groupBy("dims", "label").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).join(
        asked.groupBy("dims", "label").agg(F.min("chunk").alias("c0"), F.max("chunk").alias("c1")), ["dims", "label"]
    )
    key = ["dims", "block", "chunk"]
    spans = durable(spans)
    left = join_small(asked, spans, ["dims", "label"], "inner", F.lit(48)).select("dims", F.explode(F.sequence("b0", "b1")).alias("block"), "chunk", "id", "label", "v")
    right = join_small(rows, spans, ["dims", "label"], "inner", F.lit(48)).select("dims", "block", F.explode(F.sequence("c0", "c1")).alias("chunk"), "id", "label", "v")
    near = left.groupBy(*key).cogroup(fresh(right).groupBy(*key)).applyInArrow(positives_of(positives), "anchor_id long, positive_id long, positive_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("n", first).where(F.col("n") <= positives)

    # 50 p <= 100 x is x >= ceil(p / 2); decimals keep the products whole
    wide = F.col("positive_score").cast("decimal(24,0)")
    near = near.select(
        "anchor_id", "positive_id", F.col("positive_score").alias("score"),
        F.ceil(wide * low / 100).cast("bigint").alias("low"), F.floor(wide * high / 100).cast("bigint").alias("high"),
    ).where("low <= high")
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score", "low", "high")).alias("windows"))
    asked = asked.join(windows, "id")
    chunks = asked.groupBy("dims").agg(F.max("chunks").alias("chunks"))
    left = asked.select("dims", _every(F.col("blocks")).alias("block"), "chunk", "id", "label", "v", "windows")
    right = join_small(rows, chunks, ["dims"], "inner", F.lit(16)).select("dims", "block", _every(F.col("chunks")).alias("chunk"), "id", "label", "v")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = left.groupBy(*key).cogroup(fresh(right).groupBy(*key)).applyInArrow(negatives_of(negatives), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

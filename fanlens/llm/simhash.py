"""SimHash near-dedup by a binary trie self-join of fingerprints.

Texts are fingerprinted from their word shingles; equal fingerprints collapse to
one row.  Distinct fingerprints are joined with themselves by walking pairs of
binary trie nodes together: a pair carries the differing bits so far, and is
dropped as soon as they exceed the error budget.

The walk is dealt out at the trie's upper nodes.  Of budget + 1 bit blocks at
least one agrees between two fingerprints within the budget, so there is one
trie for each block with that block's bits first, and a task walks the subtries
below equal first blocks.  A subtrie with more than ``CELL_ROWS`` fingerprints is
dealt again by node pairs below it, with the differing bits they have.

A task emits a spanning forest of the links it finds, never all pairs;
components are then joined by star contraction.

Defined cases: words are separated by ASCII white space, A-Z are lower-cased; a
text with fewer words than a shingle is one shingle; a null, empty or blank text
has fingerprint zero, which links like any other.  Repeated rows and null ids
are fingerprinted each; the component id is the smallest non-null id reachable
(null if there is none).  Other columns pass through where rows are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.llm.common import bounded_batches, durable, free_name, join_small
from fanlens.llm.components import connected, local_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
CELL_ROWS = 50_000  # fingerprints of a subtrie that one task walks
CHUNK_ROWS = 200_000  # fingerprints of subtries that are walked together
LEAF = 64  # pairs of fingerprints below a node pair that are compared at once
FRONTIER = 500_000  # node pairs held at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 50_000):
        values = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 50_000], ends[at : at + 50_000], strict=True)], ">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, with fp (long)."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    source = free_name(docs, "source_text")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = np.array([fingerprint(x, shingle) for x in pdf[source]], np.int64)
            yield pdf[kept].assign(fp=fps)

    return bounded_batches(docs).select(*kept, F.col(text).alias(source)).mapInPandas(run, schema)


def blocks_of(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks that cover the 64 bits."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:])), strict=False))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, start2: np.ndarray, stop2: np.ndarray, depth: np.ndarray, err: np.ndarray, budget: int) -> np.ndarray:
    """Component labels of ``fp`` under links found below the given node pairs.

    A node is a range of ``fp`` (uint64, sorted within each node, first trie bit
    highest); a pair of equal ranges is a node with itself."""
    label = np.arange(len(fp))
    todo = [(start, stop, start2, stop2, depth, err)]
    ones = {}
    while todo:
        a, b, c, d, k, e = todo.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [tuple(x[half:] for x in (a, b, c, d, k, e)), tuple(x[:half] for x in (a, b, c, d, k, e))]
            continue
        small = ((b - a) * (d - c) <= LEAF) | (k >= 64)
        if small.any():
            n, m = (b - a)[small], (d - c)[small]
            each = n * m
            of = np.repeat(np.arange(len(each)), each)
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = a[small][of] + at // m[of], c[small][of] + at % m[of]
            near = (i < j) & (_popcount(fp[i] ^ fp[j]) <= budget) if len(i) else np.zeros(0, bool)
            label = local_components(len(fp), i[near], j[near], label)
            a, b, c, d, k, e = (x[~small] for x in (a, b, c, d, k, e))
        if not len(a):
            continue
        parts = []
        for bit in np.unique(k):
            if bit not in ones:  # ones before each place: where a node's right child starts
                ones[bit] = np.concatenate(([0], np.cumsum(fp >> np.uint64(63 - bit) & np.uint64(1)))).astype(np.int64)
            at = k == bit
            p, q, r, s, x = a[at], b[at], c[at], d[at], e[at]
            mid, mid2 = q - (ones[bit][q] - ones[bit][p]), s - (ones[bit][s] - ones[bit][r])
            own = p == r
            for lo, hi, lo2, hi2, more, keep in (
                (p, mid, r, mid2, 0, True), (mid, q, mid2, s, 0, True), (p, mid, mid2, s, 1, True), (mid, q, r, mid2, 1, ~own)
            ):
                alive = (lo < hi) & (lo2 < hi2) & (x + more <= budget) & keep
                parts.append((lo[alive], hi[alive], lo2[alive], hi2[alive], np.full(alive.sum(), bit + 1), x[alive] + more))
        todo.append(tuple(np.concatenate(x) for x in zip(*parts)))
    return label


def _walked(budget: int):
    """Rows sorted by cell (trie, block, node pair): link every fingerprint to the smallest of its component."""
    blocks = blocks_of(budget)

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[["trie", "block", "deeper", "p", "q"]].to_numpy()
        fp = pdf["fp"].to_numpy().view(np.uint64)
        first = np.array([x for x, _ in blocks], np.uint64)[key[:, 0]]
        turned = fp << first | np.where(first > 0, fp >> (np.uint64(64) - np.maximum(first, np.uint64(1))), np.uint64(0))
        order = np.lexsort((turned, key[:, 4], key[:, 3], key[:, 2], key[:, 1], key[:, 0]))
        key, fp, turned = key[order], fp[order], turned[order]
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        end = np.append(cut[1:], len(key))
        trie, _, deeper, p, q = key[cut].T
        depth = np.array([n for _, n in blocks])[trie] + deeper
        # below a node pair the left node's fingerprints come first
        side = np.where(key[:, 2] > 0, (turned << np.array([n for _, n in blocks], np.uint64)[key[:, 0]]) >> (np.uint64(64) - np.maximum(key[:, 2], 1).astype(np.uint64)), np.uint64(0))
        right = np.concatenate(([0], np.cumsum(side.astype(np.int64) != key[:, 3])))
        mid = end - (right[end] - right[cut])
        own = p == q
        label = walk(turned, cut, np.where(own, end, mid), np.where(own, cut, mid), end, depth, _popcount((p ^ q).astype(np.uint64)), budget)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"u": fp[linked].view(np.int64), "v": fp[label[linked]].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in frames:
            held.append(pdf)
            rows += len(pdf)
            if rows >= CHUNK_ROWS:
                pdf = pd.concat(held, ignore_index=True)
                last = (pdf[["trie", "block", "deeper", "p", "q"]] != pdf[["trie", "block", "deeper", "p", "q"]].iloc[-1]).any(axis=1).to_numpy()
                whole = int(last.sum())  # the last cell may go on
                if whole:
                    yield cells(pdf.iloc[:whole])
                held, rows = [pdf.iloc[whole:]], len(pdf) - whole
        if rows:
            yield cells(pd.concat(held, ignore_index=True))

    return run


def near_links(fps: DataFrame, budget: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """fps: distinct fp (long).  Returns links u, v that connect all fingerprints within ``budget`` bits."""
    blocks = blocks_of(budget)
    tries = F.array(*[
        F.struct(F.lit(t).alias("trie"), F.shiftrightunsigned(F.shiftleft("fp", first), 64 - bits).cast("int").alias("block"),
                 F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first) if first else F.lit(0)).alias("turned"))
        for t, (first, bits) in enumerate(blocks)
    ])
    rows = fps.select("fp", F.explode(tries).alias("x")).select("fp", "x.*")
    deeper = F.least(F.lit(16), F.ceil(F.log2(F.col("n") / cell_rows))).cast("int")
    hot = rows.groupBy("trie", "block").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    rows = join_small(rows, hot.select("trie", "block", deeper.alias("deeper")), ["trie", "block"], "left", F.lit(12))
    rows = rows.withColumn("deeper", F.coalesce("deeper", F.lit(0)))
    # a hot subtrie is dealt out by pairs of nodes ``deeper`` levels below it that differ in few enough bits
    masks = F.array(*[F.lit(m) for m in range(1 << 16) if m.bit_count() <= budget]) if budget <= 4 else F.sequence(F.lit(0), F.lit((1 << 16) - 1))
    bits = F.element_at(F.array(*[F.lit(n) for _, n in blocks]), F.col("trie") + 1)
    node = F.expr("cast(shiftrightunsigned(shiftleft(turned, bits), 64 - deeper) as int)")
    cold = rows.where("deeper = 0").select("fp", "trie", "block", "deeper", F.lit(0).alias("p"), F.lit(0).alias("q"))
    split = rows.where("deeper > 0").withColumn("bits", bits).withColumn("node", node)
    split = split.withColumn("other", F.explode(F.filter(masks, lambda m: (m < F.expr("shiftleft(1, deeper)")) & (F.bit_count(m) <= budget))))
    split = split.withColumn("other", F.col("node").bitwiseXOR(F.col("other")))
    split = split.select("fp", "trie", "block", "deeper", F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q"))
    dealt = cold.unionByName(split).repartition("trie", "block", "p", "q").sortWithinPartitions("trie", "block", "deeper", "p", "q")
    return dealt.mapInPandas(_walked(budget), "u long, v long")


def _roots(fps: DataFrame, budget: int) -> DataFrame:
    """fps: distinct fp.  fp, root (a fingerprint of its component) of those that link with another."""
    return durable(connected(near_links(fps, budget)).select(F.col("node").alias("fp"), "root"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component_id (smallest id reachable)."""
    ids = durable(fingerprints(docs.select(id_col, text), text, shingle))
    classes = ids.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = _roots(classes.select("fp"), budget)
    smallest = roots.join(classes, "fp").groupBy("root").agg(F.min("first").alias("first"))
    linked = roots.join(smallest, "root").select("fp", F.col("first").alias("reached"))
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("reached", "first").alias("component_id"))
    return ids.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id (null comes last), then the smallest hash of the row."""
    key, many = free_name(docs, "row_key"), free_name(docs, "row_many")
    rows = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(*docs.columns)))
    ids = durable(fingerprints(rows.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(text).alias("text")), "text", shingle))
    roots = _roots(ids.select("fp").distinct(), budget)
    ids = join_small(ids, roots, ["fp"], "left", F.lit(16)).withColumn("root", F.coalesce("root", "fp"))
    place = F.struct(F.col("id").isNull(), "id", "key")
    groups = ids.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first.key")
    met = durable(join_small(ids, groups.withColumnRenamed("key", "kept"), ["root"], "inner", F.lit(64)).select("key", "kept"))
    extra = met.where("key <> kept").select(F.col("key").alias(key)).distinct()
    twins = met.where("key = kept").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(True).alias(many))
    rows = join_small(rows, extra, [key], "left_anti", F.lit(40))
    rows = join_small(rows, twins, [key], "left", F.lit(40))
    equal = rows.where(F.col(many)).dropDuplicates([key])  # wholly equal rows: one of them
    return rows.where(F.col(many).isNull()).unionByName(equal).select(*docs.columns)

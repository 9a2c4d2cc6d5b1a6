"""Merkle manifest of a dataset, by checkpoint and recompute.

Every row is a leaf; the leaves of a group, in order, are the base of a tree in
which ``ARITY`` consecutive nodes become the digest of their digests; the groups'
roots, in order, are the base of one more tree.

Only every ``EVERY``-th level of a tree is written.  Nodes between two written
levels belong to one aligned subtree of at most ``ARITY ** EVERY`` stored nodes;
proof extraction regenerates them there, emits the siblings of each stored node,
adds what its subtree's top has above it, and forgets them.  A task holds one
subtree, however many rows a group has.

Defined cases: a null field is ``-``; a null group is a group of its own, first
in order; null order values come first, equal ones by leaf digest, and wholly
equal rows are interchangeable.  A lone leaf is its group's root, a lone group's
root is the root.  An empty table has no root and no proofs.  Columns are taken
by name and the kept ones come back as they are; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.llm.common import fresh, ranked, stored

ARITY, EVERY = 3, 6


def field(col) -> F.Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*cols) -> F.Column:
    """SHA-256 (lowercase hex) of a row's fields."""
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def proof_digest(before, after) -> F.Column:
    """SHA-256 of a proof's siblings: level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def folded_root(leaf, before, after) -> F.Column:
    """The root that ``leaf`` and a proof's siblings give."""
    steps = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(steps, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def interior(digests: list[str], steps: int) -> list[list[str]]:
    """The digests and the ``steps`` levels above them."""
    from hashlib import sha256

    levels = [digests]
    for _ in range(steps):
        below = levels[-1]
        levels.append([sha256("".join(below[k : k + ARITY]).encode()).hexdigest() for k in range(0, len(below), ARITY)])
    return levels


def steps_above(nodes: int, every: int) -> int:
    """Levels from a level of ``nodes`` nodes to the next stored one: ``every``, or fewer to the root."""
    steps = 0
    while nodes > 1 and steps < every:
        nodes, steps = -(-nodes // ARITY), steps + 1
    return steps


def _block(every: int) -> F.Column:
    return F.expr(f"i div {ARITY**every}").alias("block")


def _folded(every: int):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("i")
        n = table["n"][0].as_py()
        top = interior(table["h"].to_pylist(), steps_above(n, every))[-1][0]
        return pa.table({
            "g": [table["g"][0].as_py()], "i": [table["i"][0].as_py() // ARITY**every], "h": [top], "n": [-(-n // ARITY**every)]
        })

    return run


def stored_levels(leaves: DataFrame, every: int = EVERY) -> list[DataFrame]:
    """leaves: g, i (place in g), h, n (nodes of g).  Every ``every``-th level from the leaves up, each a written table.

    A group is in the levels up to the one where it has a single node, its root."""
    levels = [leaves]
    while not (more := levels[-1].where("n > 1")).isEmpty():
        above = more.groupBy("g", _block(every)).applyInArrow(_folded(every), "g string, i long, h string, n long")
        levels.append(stored(above, "merkle-level"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """g, h: the root of each group."""
    found = [level.where("n = 1").select("g", "h") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _extracted(every: int, kept: list[str], carried: list[str]):
    def run(nodes, tops):
        import pyarrow as pa

        nodes = nodes.sort_by("i")
        size = nodes.num_rows
        befores, afters = [], []
        if size:
            levels = interior(nodes["h"].to_pylist(), steps_above(nodes["n"][0].as_py(), every))
            up_before, up_after = tops["before"][0].as_py(), tops["after"][0].as_py()
            for at in range(size):
                before, after = [], []
                for level in levels[:-1]:
                    first = at - at % ARITY
                    before.append("".join(level[first:at]))
                    after.append("".join(level[at + 1 : first + ARITY]))
                    at //= ARITY
                befores.append(before + up_before)
                afters.append(after + up_after)
        out = {c: nodes[c] for c in kept}
        text = pa.list_(pa.string())
        out |= {"before": pa.array(befores, text), "after": pa.array(afters, text)}
        out |= {c: pa.array([tops[c][0].as_py() if size else None] * size, pa.string()) for c in carried}
        return pa.table(out)

    return run


def proofs(levels: list[DataFrame], above: DataFrame, every: int = EVERY) -> DataFrame:
    """The leaves' columns with before, after (array of strings, a level each) and ``above``'s other columns.

    above: g, before, after (what follows the group's root) and any string columns.
    ``before[k]`` and ``after[k]`` are the digests left and right of the path in its
    run on level k, joined."""
    carried = [c for c in above.columns if c not in ("g", "before", "after")]
    found = None
    for depth in reversed(range(len(levels))):
        level = levels[depth] if depth == 0 else levels[depth].where("n > 1")
        tops = level.where(f"i = 0 and n <= {ARITY**every}").select("g", F.lit(0).cast("long").alias("block")).join(above, "g")
        if found is not None:
            tops = tops.unionByName(found.select("g", F.col("i").alias("block"), "before", "after", *carried))
        kept = level.columns
        texts = T.ArrayType(T.StringType())
        schema = T.StructType(
            [*level.schema.fields, T.StructField("before", texts), T.StructField("after", texts)] + [T.StructField(c, T.StringType()) for c in carried]
        )
        parts = level.groupBy("g", _block(every)).cogroup(fresh(tops).groupBy("g", "block"))
        found = parts.applyInArrow(_extracted(every, kept, carried), schema)
        if depth:
            found = stored(found, "merkle-proofs")
    return found


class Manifest(NamedTuple):
    """Written levels of the groups' trees and of the tree above them."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    every: int


def build(rows: DataFrame, group: str, order: str, leaf: str, keep: list[str], every: int = EVERY) -> Manifest:
    """Manifest of ``rows``: leaves are ``leaf`` (a digest), by ``order`` within ``group``; ``keep`` stays with the leaves."""
    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    g = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))).alias("g")
    leaves = rows.select(g, F.col(order).alias("o"), F.col(leaf).alias("h"), *kept)
    leaves = ranked(leaves, ["g"], ["o", "h"], "i", "n")
    leaves = stored(leaves.select("g", "i", "h", "n", *[f"keep_{k}" for k in range(len(keep))]), "merkle-leaves")
    levels = stored_levels(leaves, every)
    tops = roots(levels).select(F.lit("").alias("all"), F.col("g").alias("source"), "h")
    tops = ranked(tops, ["all"], ["source"], "i", "n").select(F.col("all").alias("g"), "i", "h", "n", "source")
    return Manifest(levels, stored_levels(stored(tops, "merkle-roots"), every), every)


def prove(manifest: Manifest, keep: list[str]) -> DataFrame:
    """One row a leaf: the columns kept by ``build`` under the names ``keep``, leaf, subroot, root, before, after."""
    none = F.array().cast("array<string>")
    root = roots(manifest.top_levels)
    groups = proofs(manifest.top_levels, root.select("g", none.alias("before"), none.alias("after"), F.col("h").alias("root")), manifest.every)
    above = groups.select(F.col("source").alias("g"), "before", "after", F.col("h").alias("subroot"), "root")
    found = proofs(manifest.levels, above, manifest.every)
    named = [F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)]
    return found.select(*named, F.col("h").alias("leaf"), "subroot", "root", "before", "after")

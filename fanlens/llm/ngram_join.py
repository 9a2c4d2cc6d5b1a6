"""Jaccard self-join of word n-gram sets by vertical partitioning.

A text is the set of its distinct word shingles, as 64-bit hashes; the global order
of n-grams is the order of these hashes.  The order is cut into fragments, and the
part of a set within a fragment is a segment.

Candidates: two sets that link differ in at most ``budget`` n-grams, a number that
their sizes give.  If the order is cut into more fragments than that, some segment
of the two is equal.  Sets of similar size share a cut (sizes are in geometric
buckets; a set takes part in its own bucket's cut, and in the one below if it may link
with a set there), and meet in the buckets of equal segments.  A bucket's pairs are compared there by a parity
sketch, whose differing bits never exceed the n-grams in which the sets differ; a
pair that differs in more than its budget is no candidate.

Counting: for each set with its candidates and each fragment of the order a task
counts the partial overlaps, and these are summed up by pair: the sum is the exact
size of the intersection.

A group of near copies has a square of candidates, which are never written.  In a
round every set offers the first of its candidates that lie in other components and
were not counted yet (one in the first round, ``OFFERS`` later); these are counted,
and those that link unite components.  It ends when nobody has anything to offer:
then every candidate lies in one component or was counted and does not link, so no
link between different texts is lost, while a round writes a few rows for each set.

Equal sets are one class, so copies cost one row a task.  A bucket of equal segments
above ``CELL_ROWS`` is dealt in pairs of parts.  Components are joined by star
contraction.

Defined cases: words are separated by ASCII white space, A-Z are lower-cased; a text
with fewer words than a shingle is one shingle.  A null, empty or blank text has an
empty set and is linked with nothing.  Repeated rows and null ids are members like
others; the component id is the smallest non-null id reachable (null if there is
none).  Sets are told apart by a 64-bit hash, n-grams too.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.llm.common import durable, join_small, stored
from fanlens.llm.components import connected

WIDTH, PERCENT = 3, 90
SPARE = 1  # empty segments that the number of fragments makes up for
SKETCH_BITS = 1024
CELL_ROWS = 2_000  # sets of one segment that a task compares with each other
CHUNK_ROWS = 20_000  # sets of segments that are compared together
CHUNK_PAIRS = 200_000
OFFERS = 16  # candidates of a set that a round counts
GROUP_SETS = 128  # sets that are counted against one other in a task
FRAGMENTS, SEGMENT = 8, 4_096  # fragments in counting: so many, or more if a set has over SEGMENT n-grams in one
SPAN = 3  # a bucket's largest size is about (100 / percent) ** SPAN times its smallest
FEW_LINKS = 500_000  # links that one task joins into components
WORDS_HELD = 100_000  # word hashes that a task remembers


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    many = max(1, len(each) - width + 1)
    value = np.full(many, min(width, len(each)), np.uint64)  # a short text is no part of a longer shingle
    for k in range(min(width, len(each))):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + each[k : k + many])
    return np.unique(value)


def budget(size: int | np.ndarray, percent: int = PERCENT):
    """Most n-grams in which two sets of ``size`` n-grams together may differ and link; sizes' sum, not their mean."""
    return size - 2 * (-(-percent * size // (100 + percent)))


def partner(size: int, percent: int = PERCENT) -> int:
    """Size of the largest set that may link with one of ``size``."""
    return 100 * size // percent


def buckets(most: int, percent: int = PERCENT) -> list[int]:
    """First sizes of the buckets up to size ``most``: linked sets are in one bucket or in neighbours."""
    firsts = [1, 2]
    while firsts[-1] <= most:
        last = firsts[-1]
        for _ in range(SPAN):
            last = max(last, partner(last, percent))
        firsts.append(last + 1)
    return firsts


def cuts_of(firsts: list[int], size: int, percent: int = PERCENT) -> tuple[tuple[int, int], tuple[int, int]]:
    """(bucket, fragments) of the cuts in which a set takes part: its own, and the one below.

    No fragments: no different set that it would meet there can link with it."""
    bucket = int(np.searchsorted(firsts, size, side="right")) - 1
    out = []
    for b, meets in ((bucket, True), (bucket - 1, bucket > 0 and size <= partner(firsts[bucket] - 1, percent))):
        small = firsts[b + 1] - 1
        most = (small + partner(small, percent)) * (100 - percent) // (100 + percent)
        out.append((b, most + 1 + SPARE if meets and most else 0))
    return out[0], out[1]


def segment_keys(hashes: np.ndarray, bucket: int, fragments: int) -> np.ndarray:
    """A key for each segment of a set that must be looked at: equal segments have equal keys."""
    if not fragments:
        return np.zeros(0, np.int64)
    at = (hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    total = np.add.reduceat(_mix(hashes + np.uint64(1)), first)
    place = at[first]
    if fragments - len(first) > SPARE:  # the segments that two sets share may all be empty
        empty = np.setdiff1d(np.arange(fragments, dtype=np.uint64), place)
        place, total = np.concatenate((place, empty)), np.concatenate((total, np.zeros(len(empty), np.uint64)))
    return _mix(_mix(total + np.uint64(bucket)) + place).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the n-grams in each of SKETCH_BITS cells."""
    odd = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def class_of(hashes: np.ndarray) -> int | None:
    import xxhash

    if not len(hashes):
        return None
    value = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return value - 2**64 if value >= 2**63 else value


def _profiled(id_type, width: int, percent: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met, firsts = _Words(), set(), buckets(64, percent)
        for batch in batches:
            out: dict[str, list] = {"cls": [], "n": [], "own": [], "below": [], "sketch": []}
            for text in batch["text"].to_pylist():
                hashes = shingles(text, words, width)
                n, cls = len(hashes), class_of(hashes)
                own = below = np.zeros(0, np.int64)
                if n and cls not in met:  # copies in a task meet others through one of them
                    if len(met) >= WORDS_HELD:
                        met.clear()
                    met.add(cls)
                    if n >= firsts[-2]:
                        firsts = buckets(2 * n, percent)
                    own, below = (segment_keys(hashes, *cut) for cut in cuts_of(firsts, n, percent))
                for name, value in (("cls", cls), ("n", n), ("own", own), ("below", below), ("sketch", sketch(hashes) if len(own) + len(below) else None)):
                    out[name].append(value)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(out["cls"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["own"], longs), pa.array(out["below"], longs), pa.array(out["sketch"], pa.binary())],
                names=["id", *out],
            )

    return run


def profiles(docs: DataFrame, id_col: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, cls (hash of the set), n (its size), own and below (segment keys in two cuts), sketch; keys once a task for a class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_profiled(kind, width, percent), f"id {kind}, cls long, n long, own array<long>, below array<long>, sketch binary")


def _pairs_of(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within each cell (rows sorted by cell), some at a time."""
    key = pdf[["key", "p", "q"]].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
    size = np.diff(np.append(cut, len(key)))
    after = np.repeat(cut + size, size) - np.arange(len(key)) - 1  # rows of the cell behind each row
    at = 0
    while at < len(key):
        ends = at + max(1, int(np.searchsorted(np.cumsum(after[at:]), CHUNK_PAIRS)))
        many = after[at:ends]
        i = np.repeat(np.arange(at, at + len(many)), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        yield i, j
        at = ends


def _offered(percent: int, offers: int):
    """Rows sorted by cell: for each set its first candidates in other components (x offers y)."""

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "p", "q", "cls"], kind="stable", ignore_index=True)
        bits = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        cls, n, part, below, one, root = (pdf[c].to_numpy() for c in ("cls", "n", "part", "below", "p", "root"))
        apart = one != pdf["q"].to_numpy()
        counted = {(u, v) for u, seen in zip(pdf["cls"], pdf["counted"], strict=True) if seen is not None for v in seen}
        found = []
        for i, j in _pairs_of(pdf):
            fit = (root[i] != root[j]) & ~(below[i] & below[j]) & (~apart[i] | (part[i] != part[j]))
            most = budget(n[i] + n[j], percent)
            fit &= np.abs(n[i] - n[j]) <= most
            i, j, most = i[fit], j[fit], most[fit]
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[near], j[near]
            if counted and len(i):
                new = np.array([(u, v) not in counted for u, v in zip(np.maximum(cls[i], cls[j]).tolist(), np.minimum(cls[i], cls[j]).tolist(), strict=True)])
                i, j = i[new], j[new]
            if len(i):
                both = pd.DataFrame({"x": np.concatenate((cls[i], cls[j])), "y": np.concatenate((cls[j], cls[i])), "size": np.tile(n[i] + n[j], 2)})
                found.append(_first(both, offers))
        return _first(pd.concat(found), offers) if found else pd.DataFrame({"x": [], "y": [], "size": []}, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in frames:
            held.append(pdf)
            rows += len(pdf)
            if rows >= CHUNK_ROWS:
                pdf = pd.concat(held, ignore_index=True)
                last = (pdf[["key", "p", "q"]] != pdf[["key", "p", "q"]].iloc[-1]).any(axis=1).to_numpy()
                whole = int(last.sum())  # the last cell may go on
                if whole:
                    yield cells(pdf.iloc[:whole])
                held, rows = [pdf.iloc[whole:]], len(pdf) - whole
        if rows:
            yield cells(pd.concat(held, ignore_index=True))

    return run


def _first(offers: pd.DataFrame, most: int) -> pd.DataFrame:
    return offers.drop_duplicates().sort_values(["x", "y"], kind="stable").groupby("x").head(most)


def shared_keys(found: DataFrame) -> DataFrame:
    """found: ``profiles``.  cls, key, below, rows: the segments that more than one row has."""
    keys = found.select("cls", F.explode("own").alias("key"), F.lit(False).alias("below")).unionByName(
        found.select("cls", F.explode("below").alias("key"), F.lit(True).alias("below"))
    )
    return keys.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).where("rows > 1").dropDuplicates(["key", "cls"])


def open_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """cls, key, below, rows, root: the segments whose sets lie in more than one component (roots: cls, root)."""
    rows = join_small(keys.select("cls", "key", "below", "rows"), roots, ["cls"], "left", F.lit(16))
    rows = rows.withColumn("root", F.coalesce("root", "cls"))
    of = Window.partitionBy("key")
    return rows.withColumn("low", F.min("root").over(of)).withColumn("high", F.max("root").over(of)).where("low < high").drop("low", "high")


def candidates(keys: DataFrame, sets: DataFrame, counted: DataFrame | None, offers: int, percent: int = PERCENT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """u, v (classes, v < u), size (of both sets): the round's candidates, at most ``offers`` for each set.

    keys: cls, key, below, rows, root; sets: cls, n, sketch; counted: u, v that do not link."""
    rows = join_small(keys, sets, ["cls"], "inner", F.lit(SKETCH_BITS // 8 + 48))
    if counted is None:
        rows = rows.withColumn("counted", F.lit(None).cast("array<long>"))
    else:
        rows = join_small(rows, counted.groupBy(F.col("u").alias("cls")).agg(F.collect_list("v").alias("counted")), ["cls"], "left", F.size("counted") * 8 + 16)
    parts = F.ceil(F.col("rows") / cell_rows)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cls", "n", "below", "sketch", "root", "counted")
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    out = dealt.mapInPandas(_offered(percent, offers), "x long, y long, size long")
    out = out.withColumn("k", F.dense_rank().over(Window.partitionBy("x").orderBy("y"))).where(F.col("k") <= offers)
    return out.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"), "size").distinct()


def _segmented(width: int, fragments: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for text in batch["text"].to_pylist():
                hashes = shingles(text, words, width)
                if not len(hashes):
                    continue
                at = (hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                ends = np.append(first[1:], len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_of(hashes)] * len(first), pa.int64()), pa.array(at[first].astype(np.int32)),
                        pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                    ],
                    names=["cls", "fragment", "segment"],
                )

    return run


def segments(docs: DataFrame, found: DataFrame, classes: DataFrame, id_col: str, text: str, width: int = WIDTH) -> DataFrame:
    """cls, fragment, segment (sorted hashes) of one text of each of ``classes`` (cls)."""
    mine = join_small(found.select("id", "cls", "n"), classes, ["cls"], "left_semi", F.lit(8))
    ids = durable(mine.groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    most = ids.agg(F.max("n")).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    some = join_small(rows, ids.where("id is not null").select("id").distinct(), ["id"], "left_semi", F.lit(16))
    if not ids.where("id is null").isEmpty():  # classes whose rows have no id
        some = some.unionByName(rows.where("id is null"))
    cut = some.select("text").mapInArrow(_segmented(width, max(FRAGMENTS, -(-most // SEGMENT))), "cls long, fragment int, segment binary")
    return join_small(cut, classes, ["cls"], "left_semi", F.lit(8)).dropDuplicates(["cls", "fragment"])


def _overlaps(table):
    import pyarrow as pa

    v = table["v"][0].as_py()
    sets = dict(zip(table["cls"].to_pylist(), table["segment"].to_pylist(), strict=True))
    base = np.frombuffer(sets.pop(v, b""), np.uint64)
    us, parts = [], []
    for u, segment in sets.items():
        mine = np.frombuffer(segment, np.uint64)
        small, large = (mine, base) if len(mine) < len(base) else (base, mine)
        same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if same:
            us.append(u)
            parts.append(same)
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array([v] * len(us), pa.int64()), "part": pa.array(parts, pa.int64())})


def overlaps(pairs: DataFrame, parts: DataFrame, group_sets: int = GROUP_SETS) -> DataFrame:
    """u, v, both: the size of the intersection of each of ``pairs``' sets, summed up over the fragments.

    parts: ``segments``.  A set that many pairs share is dealt over groups of them."""
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / group_sets).alias("groups"))
    dealt = join_small(pairs, many, ["v"], "inner", F.lit(16)).select("u", "v", F.pmod(F.xxhash64("u"), F.col("groups")).alias("group"))
    needs = dealt.select(F.col("u").alias("cls"), "v", "group").unionByName(dealt.select(F.col("v").alias("cls"), "v", "group").distinct())
    rows = join_small(parts, needs.select("cls").distinct(), ["cls"], "left_semi", F.lit(8)).join(needs, "cls")
    rows = rows.groupBy("v", "group", "fragment").applyInArrow(_overlaps, "u long, v long, part long")
    return rows.groupBy("u", "v").agg(F.sum("part").alias("both"))


def components(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, cell_rows: int = CELL_ROWS, group_sets: int = GROUP_SETS) -> DataFrame:
    """cls, root (the smallest class reachable) of the classes that link with another."""
    keys = stored(shared_keys(found), "shared-segments")
    sets = found.where(F.col("sketch").isNotNull()).select("cls", "n", "sketch")
    sets = durable(join_small(sets, keys.select("cls").distinct(), ["cls"], "left_semi", F.lit(8)).dropDuplicates(["cls"]))
    keys = keys.withColumn("root", F.col("cls"))
    roots = counted = parts = None
    while True:
        pairs = durable(candidates(keys, sets, counted, 1 if parts is None else OFFERS, percent, cell_rows))
        if pairs.isEmpty():
            break
        if parts is None:  # whoever has a candidate at all is in the first round's pairs
            classes = durable(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct())
            parts = stored(segments(docs, found, classes, id_col, text, width), "shingle-segments")
        judged = pairs.join(overlaps(pairs, parts, group_sets), ["u", "v"], "left")
        both = F.coalesce("both", F.lit(0))
        judged = durable(judged.select("u", "v", (both * 100 >= (F.col("size") - both) * percent).alias("link")))
        more, less = judged.where("link").select("u", "v"), judged.where("NOT link").select("u", "v")
        counted = less if counted is None else counted.unionByName(less)
        if more.isEmpty():
            continue
        # components of components: later rounds join what the first ones left apart
        named = more if roots is None else _by_root(more, roots)
        step = connected(named, FEW_LINKS).select(F.col("node").alias("cls"), "root")
        roots = durable(step if roots is None else _joined(roots, durable(step)))
        keys = stored(open_keys(keys, roots), "open-segments")
    return found.sparkSession.createDataFrame([], "cls long, root long") if roots is None else roots


def _by_root(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with each class's root in its place."""
    for c in ("u", "v"):
        pairs = join_small(pairs, roots.select(F.col("cls").alias(c), F.col("root").alias(f"{c}_root")), [c], "left", F.lit(16))
    return pairs.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))


def _joined(roots: DataFrame, step: DataFrame) -> DataFrame:
    """Components that ``step`` (roots of roots) has united."""
    onward = step.select(F.col("cls").alias("root"), F.col("root").alias("further"))
    moved = join_small(roots, onward, ["root"], "left", F.lit(16)).select("cls", F.coalesce("further", "root").alias("root"))
    new = join_small(step, roots.select("cls"), ["cls"], "left_anti", F.lit(8)).select("cls", "root")
    return moved.unionByName(new)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, cell_rows: int = CELL_ROWS, group_sets: int = GROUP_SETS) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles (long), component_id (smallest id reachable by links)."""
    found = stored(profiles(docs, id_col, text, width, percent), "shingle-profiles")
    near = components(docs, found, id_col, text, width, percent, cell_rows, group_sets)
    classes = found.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    classes = join_small(classes, near, ["cls"], "left", F.lit(16)).where("rows > 1 or root is not null")
    classes = durable(classes.withColumn("root", F.coalesce("root", "cls")))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "root").select("cls", "component_id")
    # only sets with a copy or a link are looked up: others are their own component
    out = join_small(found.select("id", "cls", "n"), named, ["cls"], "left", F.lit(16))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

"""Merkle manifest, hard negatives and the n-gram Jaccard join against plain versions."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanlens.llm import hard_negatives, manifest, ngram_join
from fanlens.llm.common import ranked

SF = "/root/testdata/sf0.001"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# --- ranked ---------------------------------------------------------------------------------


def test_ranked_numbers_a_hot_group_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(5)}", rng.randrange(300)) for _ in range(3000)]
    got = ranked(spark.createDataFrame(rows, "s string, x int").repartition(7), ["s"], ["x"], "at", "all").collect()
    sizes = Counter(s for s, _ in rows)
    by = {s: sorted((r["at"], r.x) for r in got if r.s == s) for s in sizes}
    for s, n in sizes.items():
        assert [a for a, _ in by[s]] == list(range(n))
        assert [x for _, x in by[s]] == sorted(x for t, x in rows if t == s)
    assert all(r["all"] == sizes[r.s] for r in got)


# --- Merkle manifest ------------------------------------------------------------------------


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + 3]) for k in range(0, len(below), 3)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    """rows: (group, order, leaf).  {(group, order, leaf): (subroot, root, siblings)}"""
    groups = {}
    for g, o, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((o, leaf))
    trees = {g: plain_tree([leaf for _, leaf in v]) for g, v in groups.items()}
    top = plain_tree([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, v) in enumerate(groups.items()):
        for at, (o, leaf) in enumerate(v):
            path = plain_path(trees[g], at) + plain_path(top, k)
            out.append((g, o, leaf, trees[g][-1][0], top[-1][0], tuple(("".join(b), "".join(a)) for b, a in path)))
    return out


@pytest.mark.parametrize("every", [1, 2, 6])
def test_manifest_equals_plain_tree(spark, every):
    rng = random.Random(every)
    rows = [("hot", i) for i in range(200)] + [(f"s{k}", i) for k in range(11) for i in range(rng.randrange(1, 30))]
    rows += [(None, i) for i in range(10)] + [("é", 1), ("lone", None), ("z", None), ("z", 4), ("z", 4)]
    rows = [(g, o, H(str(g), str(o))) for g, o in rows]
    df = spark.createDataFrame(rows, "source string, id long, leaf string").withColumn("g", F.lit(1)).withColumn("before", F.lit(2))
    built = manifest.build(df.repartition(5), "source", "id", "leaf", keep=["source", "id"], every=every)
    got = manifest.prove(built, ["source", "id"]).collect()
    found = [(r.source, r.id, r.leaf, r.subroot, r.root, tuple(zip(r.before, r.after))) for r in got]
    key = lambda r: repr(r)
    assert sorted(found, key=key) == sorted(plain_manifest(rows), key=key)
    # every proof leads to the root, and to another one from another leaf
    checked = manifest.prove(built, ["id"]).select(
        (manifest.folded_root(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")).alias("same"),
        (manifest.folded_root(F.lit("x"), F.col("before"), F.col("after")) == F.col("root")).alias("forged"),
    )
    assert {(r.same, r.forged) for r in checked.collect()} == {(True, False)}


def test_manifest_stores_every_few_levels_only(spark):
    df = spark.range(1000).select(F.lit("a").alias("source"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    built = manifest.build(df, "source", "id", "leaf", keep=[], every=3)
    assert [level.count() for level in built.levels] == [1000, 38, 2, 1]


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "source string, id long, leaf string")
    assert manifest.prove(manifest.build(df, "source", "id", "leaf", keep=["id"]), ["id"]).count() == 0


def test_leaf_fields(spark):
    df = spark.createDataFrame([(12, None, "é\n", "")], "a long, b string, c string, d string")
    r = df.select(manifest.leaf_digest(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h")).first()
    assert r.h == H("2:12", "-", "3:é\n", "0:")


# --- hard negatives -------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, k=5, m=3):
    """rows: (id, label, list of ints).  Set of result rows."""
    out = set()
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va)))
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            fits = [(i, -t) for t, i, lab in scored if lab != la and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(fits[:m])}
    return out


def _mined(df, anchor, **kw):
    return [tuple(r) for r in hard_negatives.mine(df, anchor, **kw).collect()]


@pytest.mark.parametrize("block,chunk", [(8_192, 1_024), (40, 7)])
def test_hard_negatives_equal_brute_force(spark, block, chunk):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):  # a third of all rows in one label, ties from few distinct values
        label = 0 if i % 3 == 0 else int(rng.integers(1, 9))
        base = np.ones(12) * (label == 0) + rng.integers(-2, 3, 12) / 4
        rows.append((i, label, base.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("dims", F.lit("x"))
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    got = _mined(df, F.col("vec_id") % 10 == 0, block_rows=block, chunk_rows=chunk)
    want = plain_negatives(whole, lambda a: a % 10 == 0)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_hard_negative_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 2, [0.9, 0.1]), (4, 3, [0.6, 0.0]), (5, 3, [0.96, 0.0]), (6, 3, [0.4, 0.0]),
        (7, None, [0.9, 0.0]), (None, 2, [0.9, 0.0]), (8, 2, None), (9, 2, [nan, 1.0]), (10, 2, [inf, 0.0]), (11, 2, [0.9, None]),
        (12, 2, [0.9]), (13, 2, []), (2, 2, [0.9, 0.1]), (2, 3, [0.9, 0.1]), (14, 1, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = _mined(df, F.col("vec_id") == 0)
    # ids that repeat count once, ties go to the smaller id; a negative positive score has no window
    assert sorted(got) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880), (0, 1, 3, 4, 65536, 39168)]
    assert _mined(df.limit(0), F.col("vec_id") == 0) == []
    assert _mined(df, F.lit(None).cast("boolean")) == []
    big = spark.createDataFrame([(0, 1, [1e12, 3.0]), (1, 1, [1e3, 2.0]), (2, 2, [9e2, 0.0])], "vec_id long, label int, embedding array<double>")
    p = int(256e12) * 256_000 + 768 * 512
    n = int(256e12) * 230_400
    top = 2**63 - 1
    assert p > top and n > top and 50 * top <= 100 * n
    assert _mined(big, F.col("vec_id") == 0) == []  # the positive's score is cut to a long, the negative's is above its window


def test_pruning_drops_candidates_before_the_last_column():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (500, 64))
    rows[:3] = 60 * np.sign(rows[0])
    block = hard_negatives.Columns(rows, np.int64)
    live = []

    def watched(prune):
        def run(lower, upper):
            keep = prune(lower, upper)
            live.append(int(keep.sum()))
            return keep

        return run

    left, score = block.scan(rows[0], np.arange(1, 500), watched(hard_negatives.may_be_best(2)))
    assert set(left) >= {1, 2} and sorted(score)[-2:] == [230400, 230400]
    assert live[-1] == 2 and live[-3] < 400


# --- n-gram Jaccard join --------------------------------------------------------------------


def plain_sets(texts, width=3):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        n = min(width, len(words))
        out.append({b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set())
    return out


def plain_components(ids, texts, percent=90):
    sets = plain_sets(texts)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k))) for k, i in enumerate(ids))


def _components(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return Counter(tuple(r) for r in ngram_join.jaccard_components(df, **kw).collect())


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_components_equal_brute_force_on_documents(spark):
    from fanlens.llm.queries import op13_ngram_jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_components([r.doc_id for r in docs], [r.text for r in docs])
    assert Counter(tuple(r) for r in op13_ngram_jaccard(spark, SF).collect()) == want


@pytest.mark.parametrize("cell,group", [(2_000, 128), (8, 4)])
def test_jaccard_components_equal_brute_force_on_edits(spark, cell, group):
    rng = random.Random(cell)
    texts = []
    for size in (3, 9, 10, 11, 12, 19, 20, 30, 60, 150, 400):  # near and just too far, chains, a common passage
        base = [f"v{rng.randrange(400)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join(base + ["end"])]
        texts += [_edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8) if k < size for _ in range(3)]
    base = [f"u{k}" for k in range(120)]  # many different near copies, many equal ones
    texts += [_edited(rng, base, rng.randrange(4)) for _ in range(60)] + [" ".join(base)] * 40
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = plain_components([i for i, _ in rows], [t for _, t in rows])
    assert len({c for _, _, c in want}) < 0.8 * len(rows)
    assert _components(spark, rows, cell_rows=cell, group_sets=group) == want


def test_jaccard_cases(spark):
    long = " ".join(f"x{k}" for k in range(9_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "one"), (8, "Été a b"), (9, "été a b"),
        (10, "a b c d"), (11, "a b c d"), (12, long), (13, long + " end"), (5, "one two"), (None, "one two"), (None, "lost words here"), (None, None),
        (None, long + " other"),
    ]
    want = plain_components([i for i, _ in rows], [t for _, t in rows])
    assert _components(spark, rows) == want
    assert want[(13, 8_999, 12)] == 1 and want[(5, 1, 4)] == 2 and want[(None, 8_999, 12)] == 1
    assert _components(spark, []) == Counter()
    assert _components(spark, [(None, "a b c d e f g h i j k l m"), (None, "a b c d e f g h i j k l m n")]) == Counter({(None, 11, None): 1, (None, 12, None): 1})


def test_budget_and_cuts():
    firsts = ngram_join.buckets(400)
    for a in range(1, 150):
        for b in range(a, 175):
            links = [i for i in range(a + 1) if 100 * i >= 90 * (a + b - i)]
            if not links:
                continue
            assert ngram_join.budget(a + b) == a + b - 2 * links[0] and b <= ngram_join.partner(a)
            if ngram_join.budget(a + b):  # some cut is shared and has more fragments than the sets differ
                shared = set(ngram_join.cuts_of(firsts, a)) & set(ngram_join.cuts_of(firsts, b))
                assert max(f for _, f in shared) > ngram_join.budget(a + b)
                own, below = ngram_join.cuts_of(firsts, a), ngram_join.cuts_of(firsts, b)
                assert own[0] in (below[0], below[1])  # the smaller set is there by its own bucket
    # keys of the two cuts of one set differ
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64))
    (p, f), (q, g) = ngram_join.cuts_of(firsts, 300)
    assert not set(ngram_join.segment_keys(x, p, f)) & set(ngram_join.segment_keys(x, q, g or 40))


def test_components_of_few_links_in_one_task(spark):
    from fanlens.llm.components import connected

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = sorted(tuple(r) for r in connected(df).collect())
    assert sorted(tuple(r) for r in connected(df, few=1000).collect()) == want
    assert connected(df.limit(0), few=10).count() == 0

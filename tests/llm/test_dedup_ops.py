"""SimHash, components and suffix-array dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fanlens.llm import common, simhash, suffix_dedup
from fanlens.llm.components import connected, local_components
from fanlens.llm.suffix_groups import common_prefixes, longest_earlier, suffix_array

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    n = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    u = np.array(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    return local_components(len(u), i, j)


def test_fingerprint_is_spark_xxhash64(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("ab cd é x",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest("ab cd é x", 42)
    for text in [None, "", " \t\n", "One", "a b c", "A b\x0bC\u00a0d e É", "w " * 300, "a b c d e f g"]:
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_near_components_equal_brute_force(spark):
    from fanlens.llm.queries import op5_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    label = brute_components(fps)
    want = {i: (f"{f:016x}", ids[k]) for i, f, k in zip(ids, fps, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, SF).collect()} == want
    assert len(set(label)) < len(ids)


def _close(rng, base, most):
    out = []
    for b in base:
        m = 0
        for k in rng.choice(64, rng.integers(1, most + 1), replace=False):
            m |= 1 << int(k)
        x = (int(b) & (2**64 - 1)) ^ m
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


@pytest.mark.parametrize("cell_rows", [50_000, 20])
def test_trie_join_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 500).tolist()
    x = np.unique(np.array(base + _close(rng, base, 6) + _close(rng, base, 9) + _close(rng, [0] * 400, 3), np.int64))
    want = brute_components(x.view(np.uint64))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in x], "fp long"), 4, cell_rows).toPandas()
    place = {int(v): k for k, v in enumerate(x)}
    got = local_components(len(x), links["u"].map(place).to_numpy(), links["v"].map(place).to_numpy())
    assert (got == want).all()
    roots = {r.node: r.root for r in connected(spark.createDataFrame(links)).collect()}
    assert all(roots.get(int(v), int(v)) == min(int(x[k]) for k in np.flatnonzero(want == want[i])) for i, v in enumerate(x))


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100)], "u long, v long")
    assert {r.root for r in connected(links).collect()} == {0}
    assert connected(links.limit(0)).count() == 0


def test_simhash_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(5, None, 1), (3, " ", 2), (None, "", 3), (9, "one two three four five", 4), (9, "one two three four five", 4), (2, "ONE two three four five", 5)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_components(df).collect())
    assert got == [(0, 3), (2, 2), (3, 3), (5, 3), (9, 2), (9, 2)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.fp for r in kept.collect()) == [2, 5]  # of the empty texts id 3 stays, not the one without id
    same = spark.createDataFrame([(i, "one two three four five", fp) for i, fp in ((1, 7), (1, 7), (None, 7), (None, 7), (1, 8), (4, 1))], "doc_id long, text string, row_key int")
    assert [r.doc_id for r in simhash.keep_one(same).collect()] == [1]
    alone = spark.createDataFrame([(None, "a b c d e", 1), (None, "a b c d e", 1), (None, "v w x y z", 1)], "doc_id long, text string, fp int")
    assert sorted(r.text for r in simhash.keep_one(alone).collect()) == ["a b c d e", "v w x y z"]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_suffix_array_and_longest_earlier():
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(0, 40))] + [0]
        order = suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        common_, age = common_prefixes(x, order), rng.sample(range(len(x)), len(x))
        same = lambda i, j: next((k for k in range(len(x)) if i + k >= len(x) or j + k >= len(x) or x[i + k] != x[j + k]), 0)
        assert longest_earlier(order, common_, age) == [max((same(i, j) for j in range(len(x)) if age[j] < age[i]), default=0) for i in range(len(x))]


def brute_cut(docs):
    seen, out = set(), {}
    for i, d in sorted(docs):
        gone = bytearray(len(d))
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(d[p : p + 100])
        out[i] = (len(d), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(d))), bytes(x for x, g in zip(d, gone) if not g))
    return out


def cut(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(df).collect()}


def mixed_docs(n, seed):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("ab cdéf") for _ in range(k))
    pool = [noise(rng.randint(60, 400)) for _ in range(10)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(pool)
            x = x[rng.randint(0, 30) : len(x) - rng.randint(0, 40)]
            if x and rng.random() < 0.3:
                k = rng.randrange(len(x))
                x = x[:k] + "X" + x[k + 1 :]
            text += x + (noise(rng.randint(0, 150)) if rng.random() < 0.5 else "")
        docs.append((3 * i, text))
    return [*docs, (1, None), (2, ""), (4, "a" * 500), (5, "a" * 300 + "b" + "a" * 120), (1000, docs[7][1]), (1001, "x" * 99), (1003, "x" * 100)]


@pytest.mark.parametrize("wide, held", [(256, 400_000), (1, 400_000), (2, 50)])
def test_cut_equals_brute_force(spark, monkeypatch, wide, held):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "HELD_ANCHORS", held)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000 if held == 50 else 1 << 20)
    docs = mixed_docs(100, wide)
    assert cut(spark, docs) == brute_cut([(i, (t or "").encode()) for i, t in docs])


def test_cut_with_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    docs = mixed_docs(40, 9)
    assert cut(spark, docs, 5) == brute_cut([(i, (t or "").encode()) for i, t in docs])


def test_cut_whole_table(spark):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert cut(spark, [(i, t.decode()) for i, t in docs]) == brute_cut(docs)


def test_cut_shared_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    df = spark.createDataFrame([(7, text, 1), (7, text, 1), (None, text, 2), (None, text + "!", 3), (8, "", 4)], "doc_id long, text string, o int")
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(df).collect())
    assert got == [(7, 150, 0), (7, 150, 0), (8, 0, 0), (99, 150, 150), (99, 151, 150)]
    same = spark.createDataFrame([(7, "c" * 150), (7, "c" * 150)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.cut_repeats(same).collect()] == [(149, 1)] * 2
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0

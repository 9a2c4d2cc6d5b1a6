"""SentencePiece, decontamination, line dedup, sharding and URL rules against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanlens.llm import decontamination, line_dedup, pieces, sharding, url_filter
from fanlens.llm.queries import URL_RULES, piece_model

SF = "/root/testdata/sf0.001"
SCRAPS = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "\t", "é", "Ａ", "ﬁ", "😀", "<s>", "</s>", "\x00", "日", ".", "%%%", "   ", "　", "<unk>", "<0x0A>", "▁ "]


def edit_distance_to_substring(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        left, row[0] = row[0], 0
        for i, p in enumerate(item):
            left, row[i + 1] = row[i + 1], min(left + (p != c), row[i] + 1, row[i + 1] + 1)
        best = min(best, row[-1])
    return best


def test_chunk_table_equals_library(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "x" * 20_000]
    table = pieces.ChunkTable(piece_model())
    monkeypatch.setattr(pieces, "TABLE_WORDS", 200)  # the table is emptied again and again
    for at in range(0, len(texts), 100):
        for text, (ids, decoded) in zip(texts[at : at + 100], table.encode(texts[at : at + 100])):
            want = table.model.encode(text or "", add_bos=True, add_eos=True)
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded == table.model.decode(want)


def test_encode_whole_table(spark):
    from fanlens.llm.queries import op3_sentencepiece

    model = pieces.ChunkTable(piece_model()).model
    got = {r.doc_id: r for r in op3_sentencepiece(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = model.encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_encode_nulls_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x", "s"), (None, "a  b", "y", "s"), (None, "a  b", "y", "s")], "doc_id long, text string, ids string, source_text string")
    out = pieces.encode_texts(df, piece_model())
    assert out.columns == ["doc_id", "source_text", "ids", "decoded"]
    assert sorted((r.doc_id or -1, r.decoded) for r in out.collect()) == [(-1, "a  b"), (-1, "a  b"), (1, "")]
    assert pieces.encode_texts(df.limit(0), piece_model()).count() == 0


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.7:
            k = rng.randint(0, len(item))
            text += item[:k] + rng.choice(["", "a", "bb"]) + item[k:] + text
        budget = rng.randint(0, len(item))
        got, want = decontamination.myers(item, text, budget), edit_distance_to_substring(item, text)
        assert (got[0] if got else None) == (want if want <= budget and text else None)


def test_pigeonhole_finds_every_item_within_budget():
    rng = random.Random(3)
    items = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60)))) for k in range(20)]
    automaton = decontamination.build(items, 0.1)
    for _ in range(150):
        text = list("".join(rng.choice("abcd ") for _ in range(40)) + rng.choice(items)[1] + "dd" + rng.choice(items)[1])
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(len(text))] = rng.choice(["", "a", "xy"])
        text = "".join(text)
        got = {k: d for k, _, _, d in decontamination.find(text, items, automaton, 0.1)}
        want = {k: d for k, t in items if (d := edit_distance_to_substring(t, text)) <= int(len(t) * 0.1)}
        assert got == want


def test_matched_span_has_the_distance():
    items = [(7, "the cat sat on the mat")]
    [(k, a, b, d)] = decontamination.find("zz the cat sat on a mat yy", items, decontamination.build(items, 0.2), 0.2)
    assert (k, d, "zz the cat sat on a mat yy"[a:b]) == (7, 3, "the cat sat on a mat")


def test_contaminated_equals_brute_force(spark):
    from fanlens.llm.queries import op10_decontamination

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in op10_decontamination(spark, SF).where("distance = 0").collect()}
    assert got == {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} != set()


def test_other_case_and_wrapping_are_found_at_their_place(spark):
    items = [(1, "Which planet is the Largest of them all?"), (2, " straße  und \n weg zum fluss"), (3, "  ")]
    passages = [items[0][1].upper(), items[0][1].replace(" ", "\n   "), "STRASSE UND\tWEG ZUM FLUSS"]
    docs = spark.createDataFrame([(k, f"İntro  {p} \n end") for k, p in enumerate(passages)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.distance) for r in decontamination.contaminated(docs, bench).collect()}
    want = {(k, 2 if k == 2 else 1): (7, 7 + len(p), 0) for k, p in enumerate(passages)}
    assert got == want
    assert decontamination.decontaminate(docs, bench).count() == 0
    for text in ["", "İ ß\n\nx", "ﬁ Σς  "]:
        assert len(decontamination.places(text)) == len(decontamination.folded(text))


def test_decontaminate_in_blocks_nulls_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "xx hello world, dear friends yy", 5), (2, None, 6), (None, "", 7), (3, "nothing here", 8), (3, "nothing here", 8)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(1, "hello world, dear friends"), (2, None), (None, "zz"), (4, "")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 5)  # an item a block
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.matches) for r in clean.collect()) == [(0, 7), (2, 6), (3, 8), (3, 8)]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 5
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_line_dedup_defined_cases(spark):
    rows = [(k, f"menu\nown {k}\n\n menu ", "a", 1) for k in range(20)] + [(50, "menu\nrare", "b", 1), (51, None, "a", 1), (None, "", None, 1), (52, "menu", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[50].text == "menu\nrare"  # another host, too few pages
    assert got[51].text is None and got[51].n_lines == 0
    assert got[None].text == "" and got[52].text == ""
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_line_dedup_shuffled_side_gives_the_same(spark, monkeypatch):
    from fanlens.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {(r.doc_id, r.text) for r in line_dedup.drop_lines(docs, ratio=0.01, min_pages=2).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {(r.doc_id, r.text) for r in line_dedup.drop_lines(docs, ratio=0.01, min_pages=2).collect()} == a


@pytest.mark.parametrize("bucket_rows", [3, 50_000])
def test_interleave_matches_the_mixture(spark, bucket_rows):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else f"s{k % 5}", k % 2) for k in range(500)] + [(1, "s1", 1)] * 3 + [(None, "hot", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int")
    got = sharding.interleave(df, 8, bucket_rows=bucket_rows).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and list(sizes.index) == list(range(8))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for _, part in got.groupby(got["source"].fillna("")):
        share = part.groupby("shard").size().reindex(range(8), fill_value=0)
        assert share.max() - share.min() <= 2


def test_interleave_is_the_same_for_any_bucketing_and_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    place = lambda df, n: sorted(map(tuple, sharding.interleave(df, 8, bucket_rows=n).select("doc_id", "shard", "slot").collect()))
    assert place(docs, 7) == place(docs.repartition(5), 1000)
    assert sharding.interleave(docs.limit(0), 8).count() == 0


def test_url_rules_equal_a_plain_loop(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://com", "http://COM/", "x://www.Example.com/en/a?b#c", "://net/es/", "http://a.net?/es/", "http://xcom/", "http://.com/x", "http://a..net/fr/é\n/x", "http://examplecom/en/"]
    for _ in range(500):
        host = ".".join(rng.choice(["www", "a", "example", "com", "net", "es"]) for _ in range(rng.randint(1, 5)))
        urls.append(f"http://{host}{rng.choice(['', '/', '/en', '/en/', '/en/x', '/es/y', '/fr/', '/e'])}{rng.choice(['', '?q=/', '#/en/'])}")
    urls += urls[:20]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*URL_RULES, ("com", "/en/", "allow"), ("com", "/en/", "block"), (None, "/", "block"), ("es", None, "block")], "host string, path string, verdict string")
    plain = [*[r for r in URL_RULES], ("com", "/en/", "block"), ("es", "", "block")]
    for r in url_filter.filter_urls(df, rules, id_col="page_id").collect():
        url = urls[r.page_id] or ""
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), url


def test_url_filter_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None)], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages, rules).where(F.col("rule") == "com/").count() == 1

"""HTML extraction, the language model, the learned index and the pipeline."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fanlens.llm import common, html_extract, learned_index, quality_lm
from fanlens.llm.queries import op1_html_extraction, op2_learned_index, op4_quality

SF = "/root/testdata/sf0.001"


def test_articles_equal_a_plain_cut(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op1_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header><h2>Site</h2></header>
<div id="menu"><ul>{menu}</ul></div><div class="cookie-notice">We use cookies</div>
<div class="content"><h1>{title}</h1>{paras}<div class="ad">Buy</div><form><p>Name</p></form>
<section class="comments"><p>First!</p></section></div><aside><p>More</p></aside><div class="footer">&copy; us</div></body></html>"""


def template_page(k, paras):
    return PAGE.format(menu="".join(f"<li><a>m{i}</a></li>" for i in range(k % 4 + 1)), title=f"Title {k}", paras="".join(f"<p>para {k} {i} &lt;x&gt;\n and more words to read</p>" for i in range(paras)))


def test_wrapper_has_slots_options_and_repeats():
    pages = [template_page(k, k % 3 + 1) for k in range(6)] + [template_page(7, 2).replace("<h1>", "<blockquote>q</blockquote><h1>")]
    w = html_extract.wrapper_of(pages[0])
    for p in pages[1:]:
        w = html_extract.align(w, html_extract.wrapper_of(p))
    text = html_extract.expression(w)
    assert "(<p> # </p>)+" in text and "<h1> # </h1>" in text and "(<blockquote>" in text and ")?" in text
    assert html_extract.content_path(w)[-1] == "div.content"
    assert html_extract.extract(pages[1], html_extract.content_path(w)) == "Title 1\npara 1 0 <x> and more words to read\npara 1 1 <x> and more words to read"


def test_hosts_without_article_element(spark, monkeypatch):
    rows = [(k, f"http://h{k % 2}.com/{k}", template_page(k, 1 + k % 4), "x") for k in range(12)]
    rows += [(50, None, None, "x"), (51, "http://h0.com/", "", "x"), (None, "http://h0.com/z", template_page(1, 1), "x"), (52, "http://one.org/", "<p>just <b>this</p>", "x"), (53, "u", "<div>" * 3000 + "deep", "x"), (54, "u", "<<a <!-- never closed", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract_articles(df).collect()}
    assert got[3] == "Title 3\n" + "\n".join(f"para 3 {i} <x> and more words to read" for i in range(4))
    assert got[50] == got[51] == "" and got[None].startswith("Title 1\n")
    assert got[52] == "just this" and got[53] == "deep" and len(got) == len(rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_extract, "FLUSH_HOSTS", 1)
    assert {r.page_id: r.text for r in html_extract.extract_articles(df.repartition(4)).collect()} == got
    assert html_extract.extract_articles(df.limit(0)).count() == 0


def brute_model(texts):
    """Interpolated modified Kneser-Ney over UTF-16 units, as dictionaries."""
    units = lambda t: [2, 2, 2, *np.frombuffer(" ".join(t.split()).encode("utf-16-le"), "<u2").tolist(), 3]
    counts = {4: Counter()}
    for t in texts:
        u = units(t)
        counts[4].update(tuple(u[k : k + 4]) for k in range(len(u) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d[n] = [min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))] if min(n1, n2, n3, n4) else [0.5, 1, 1.5]
    off = lambda n, v: d[n][min(v, 3) - 1]
    follow = defaultdict(list)
    for n, c in counts.items():
        for g, v in c.items():
            follow[n, g[:-1]].append(v)

    def p(g):
        n = len(g)
        own = follow.get((n, g[:-1]))
        if n == 1:
            w = sum(off(1, v) for v in own) / sum(own) / (len(own) + 1)
            return max(counts[1][g] - off(1, counts[1][g]), 0) / sum(own) + w if g in counts[1] else w
        if not own:
            return p(g[1:])
        w = sum(off(n, v) for v in own) / sum(own)
        seen = (counts[n][g] - off(n, counts[n][g])) / sum(own) if g in counts[n] else 0
        return seen + w * p(g[1:])

    def score(t):
        u = units(t)
        g = [tuple(u[k : k + 4]) for k in range(len(u) - 3)]
        return len(g), sum(math.log(p(x)) for x in g)

    return p, score


def test_language_model_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("aab bcé  \n😀x") for _ in range(rng.randint(0, 60)))
    rows = [(k, text(), "en" if k % 3 else None) for k in range(60)] + [(100, None, "en"), (101, "zz qq", "en"), (102, "zz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    trusted = {k for k in range(60) if k % 4 and k != 5}
    halves = {k: xxhash.xxh64_intdigest(t or "", 42) % 2 for k, t, _ in rows}
    for groups in (1 << 30, 200):
        got = {r.id: r for r in quality_lm.score(docs, labels, group_bytes=groups).collect()}
        for lang, half in (("en", 0), ("en", 1), (None, 0), (None, 1)):
            p, score = brute_model([t for k, t, x in rows if x == lang and k in trusted and halves[k] != half])
            for k, t, x in rows:
                if x == lang and halves[k] == half:
                    n, s = score(t or "")
                    assert got[k].tokens == n and got[k].logp == pytest.approx(s, rel=1e-9), k
        assert got[102].logp is None


def test_quality_keeps_trusted_and_rejects_junk(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in op4_quality(spark, "/root/testdata/sf0.01").collect()}
    good, bad = [k for k, q in labels.items() if q], [k for k, q in labels.items() if not q]
    assert sum(k in kept for k in good) >= 0.99 * len(good)
    # pages of one repeated word have the perplexity of clean text
    assert sum(k in kept for k in bad) <= 0.3 * len(bad)


def test_limit_is_the_plain_quantile_where_the_sample_shows_it(spark):
    rows = [("1en", True, k / 1000 + 0.0005) for k in range(1000)] + [("1de", True, k / 1000 + 0.0005) for k in range(100)] + [("1en", False, 9.0)]
    got = {r.lang: r for r in quality_lm.thresholds(spark.createDataFrame(rows, "lang string, trusted boolean, lp double")).collect()}
    assert got["1en"].limit == pytest.approx(0.995)
    assert got["1de"].limit == pytest.approx(0.1 + 0.5 * (0.1 - 0.05))  # half of the 200 documents are missing


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", None, 1), (None, None, "en", 2), (3, "", "xx", 3), (3, "", "xx", 3)], "doc_id long, text string, lang string, k int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted(r.k for r in quality_lm.keep_good(docs, labels).collect()) == [1, 2, 3, 3]
    assert quality_lm.keep_good(docs, labels.limit(0)).count() == 4
    assert quality_lm.keep_good(docs.limit(0), labels).count() == 0


def test_held_out_documents_are_judged_like_trained_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_lm.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.keep for r in judged if r.quality) >= 0.99 * sum(r.quality for r in judged)
    assert sum(r.keep == bool(r.quality) for r in judged) >= 0.95 * len(judged)


def test_index_recall_and_exact_scores(spark):
    from fanlens.llm.queries import op2_learned_index

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in op2_learned_index(spark, sf).collect():  # with the registered parameters
        got[r.query_id].append(r)
    hit = total = 0
    for q, v in zip(ids, x):
        if q % 20 == 0:
            s = x @ v
            s[ids == q] = -np.inf
            best = set(ids[np.argsort(-s)[:20]])
            mine = sorted(got[q], key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 21))
            assert all(a.score >= b.score for a, b in zip(mine, mine[1:]))
            assert all(r.score == pytest.approx(s[list(ids).index(r.vec_id)], abs=1e-12) for r in mine)
            hit, total = hit + len(best & {r.vec_id for r in mine}), total + 20
    assert hit >= 0.9 * total
    parts = 16
    assert parts <= len(x) / learned_index.PART_ROWS
    router = learned_index.fit(x, parts)
    own = np.bincount([p[0] for p in router.parts(x, 0.0)], minlength=parts)
    share = np.mean([own[p].sum() for p in router.parts(x[ids % 20 == 0], learned_index.MASS)]) / len(x)
    assert own.max() < 0.2 * len(x) and share < 0.9  # the vectors are mostly noise: see the README


def test_one_part_that_all_queries_visit(spark, monkeypatch):
    monkeypatch.setattr(learned_index, "QUERY_ROWS", 7)
    monkeypatch.setattr(learned_index, "BLOCK_ROWS", 11)
    rng = np.random.default_rng(0)
    rows = [(int(k), (np.array([5.0, 0.0, 0.0]) * (k % 3 == 0) + rng.standard_normal(3)).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = learned_index.nearest(df, df.where("vec_id % 4 = 0"), 3, part_rows=25, mass=1.0, sample_rows=200).collect()
    x = np.array([v for _, v in rows])
    for q in range(0, 200, 4):
        s = x @ x[q]
        s[q] = -np.inf
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-s, kind="stable")[:3].tolist()


def test_index_ties_nulls_and_few_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (5, [2.0, 1.0]), (3, [2.0, 1.0]), (9, [0.5, 0.0]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as part", "2 as id")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in learned_index.nearest(df, df.where("vec_id in (0, 8, 4)"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 5, 2.0)]
    assert learned_index.nearest(df.limit(0), df, 2).count() == 0
    assert learned_index.nearest(df, df.limit(0), 2).count() == 0


def test_index_blocks_give_the_same(spark, monkeypatch):
    a = {(r.query_id, r["rank"], r.vec_id) for r in op2_learned_index(spark, SF).collect()}
    monkeypatch.setattr(learned_index, "BLOCK_ROWS", 40)
    monkeypatch.setattr(learned_index, "QUERY_ROWS", 7)
    assert {(r.query_id, r["rank"], r.vec_id) for r in op2_learned_index(spark, SF).collect()} == a


def test_balanced_parts_are_equal():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((512, 8))
    label = learned_index.balanced_parts(learned_index.neighbour_graph(x, 6), 8, rng)
    assert np.bincount(label).tolist() == [64] * 8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from fanlens.llm import pieces
    from fanlens.llm.queries import piece_model

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "encoded":
            assert docs.columns == corpus_pipeline.COLUMNS
    quality, lines, single, clean, encoded = kept
    assert len(quality) == len(lines) > len(single) > len(clean) == len(encoded)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {k for k, r in single.items() if any(t in r.text for t in items)} == set(single) - set(clean)
    model = pieces.ChunkTable(piece_model()).model
    for k, r in encoded.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == model.encode(clean[k].text, add_bos=True, add_eos=True)
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == {k: r.n_tokens for k, r in encoded.items()}

"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

Tokens are UTF-16 code units of the text with white space runs as one space,
between three start marks and an end mark, so a 4-gram is one long, and its
history and suffix are shifts and masks of it.  One model per language is
counted over all trusted documents: 4-grams by their counts, lower orders by the
number of different tokens before them, three discounts an order from the
counts of counts, and the lower order mixed in with each history's own weight;
unigrams are mixed with a uniform share.

Documents fall into two halves by their texts' hash, and each half is judged by
the counts of the other half's trusted documents.  So no document, and no copy
of it, helps its own score, and trusted and new documents are measured alike.

Scoring joins counts, not texts.  Documents are dealt once into groups of about
``GROUP_BYTES``; each group asks for its distinct 4-grams, these are looked up by
joins sharded on (language, n-gram), and the answers return to the group, where
each document's mean log-probability is summed.  Everything gathered grows with
the input, nothing is broadcast unmeasured or collected.

A document is rejected if its log-perplexity is above its language's upper
quantile of trusted text, at every size; with few trusted documents that is the
highest of them.  Quantiles come from counts of log-perplexity in steps of 1/1000.
Texts of fewer than ``SHORT`` tokens are averaged with enough tokens of median
probability to make up ``SHORT``, as a few tokens say little.

Defined cases: a null or empty text is scored as the end mark alone; a null
language is a language of its own; a document of a language without trusted text
is kept, its perplexity and threshold null.  A document is trusted if it has labels and
all of them say quality 1.  Repeated rows are scored each; null ids are kept and
never trusted.  Equal texts of one language are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanlens.llm.common import bounded_batches, durable, join_small, stored, text_bytes

ORDER = 4
START, END = "\x02", "\x03"
GROUP_BYTES = 64 << 20
TABLE_ROWS = 1_000_000  # n-grams that a task gathers before it hands them on
QUANTILE, SHORT = 0.995, 200
STEP = 1000  # of log-perplexity
FEW_LANGUAGES = 10_000
PART_ROWS = 500_000  # n-grams of a partition
FLOOR = 0.05  # of a discount, so that every history leaves some weight to unseen tokens


def grams(text: str | None) -> np.ndarray:
    """The 4-gram that ends at each token, as a long."""
    line = START * (ORDER - 1) + " ".join((text or "").split()) + END
    u = np.frombuffer(line.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    n = len(u) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | u[k : k + n]
    return out.view(np.int64)


class _Counts:
    """Distinct n-grams and their counts by language, handed on when they fill the table."""

    def __init__(self):
        self.pending: dict = {}
        self.tables: dict = {}
        self.waiting = 0

    def add(self, name, g: np.ndarray) -> bool:
        """Whether the table is full."""
        self.pending.setdefault(name, []).append(g)
        self.waiting += len(g)
        if self.waiting < TABLE_ROWS:
            return False
        self._settle()
        return sum(len(k) for k, _ in self.tables.values()) > TABLE_ROWS

    def _settle(self) -> None:
        for name, parts in self.pending.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            if name in self.tables:
                old, had = self.tables[name]
                both, at = np.unique(np.concatenate((old, keys)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((had, counts)), len(both)).astype(np.int64)
                keys = both
            self.tables[name] = (keys, counts)
        self.pending, self.waiting = {}, 0

    def rows(self) -> Iterator[tuple]:
        self._settle()
        for name, (keys, counts) in self.tables.items():
            yield name, keys, counts
        self.tables = {}


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made = _Counts()
    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            if made.add(lang, grams(text)):
                yield from (pd.DataFrame({"lang": a, "g": k, "c": c}) for a, k, c in made.rows())
    yield from (pd.DataFrame({"lang": a, "g": k, "c": c}) for a, k, c in made.rows())


def _asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    made = _Counts()
    for pdf in frames:
        for grp, lang, blob in zip(pdf["grp"], pdf["lang"], pdf["blob"], strict=True):
            if made.add((grp, lang), grams(unpack(blob).decode())):
                yield from (pd.DataFrame({"grp": a[0], "lang": a[1], "g": k}) for a, k, _ in made.rows())
    yield from (pd.DataFrame({"grp": a[0], "lang": a[1], "g": k}) for a, k, _ in made.rows())


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for pdf in frames:
        yield pdf.drop(columns="text").assign(blob=[pack((x or "").encode()) for x in pdf["text"]])


def _scored(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    known = {}
    for lang, part in table.groupby("lang"):
        order = np.argsort(part["g"].to_numpy())
        known[lang] = part["g"].to_numpy()[order], part["logp"].to_numpy()[order]
    logp, tokens = [], []
    for lang, blob in zip(docs["lang"], docs["blob"], strict=True):
        g = grams(unpack(blob).decode())
        tokens.append(len(g))
        logp.append(known[lang][1][np.searchsorted(known[lang][0], g)].sum() if lang in known else np.nan)
    return docs[["id", "k", "lang", "trusted"]].assign(tokens=tokens, logp=logp)


def _shift(g, n: int) -> F.Column:
    return F.shiftrightunsigned(g, n)


def _suffix(g, order: int) -> F.Column:
    return F.col(g).bitwiseAND(F.lit((1 << 16 * order) - 1))


def by_language(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Join a side with a row for each language: counted, then broadcast if there are few (else AQE splits hot ones)."""
    return rows.join(F.broadcast(side) if side.count() <= FEW_LANGUAGES else side, "lang", how)


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of an order from its counts of counts (1/2, 1, 3/2 where one is missing), ``FLOOR`` at least."""
    n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    made = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    whole = F.least("n1", "n2", "n3", "n4") > 0
    good = [F.when(whole, F.greatest(F.lit(FLOOR), F.least(F.lit(float(k)), d))).otherwise(F.lit(k / 2)).alias(f"d{k}") for k, d in zip((1, 2, 3), made)]
    return counts.groupBy("lang").agg(*n).select("lang", *good)


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """counts: lang, g, c of 4-grams.  Returns by order (1 to 4) the probabilities of seen
    n-grams (lang, g, p) and the histories' weights of the lower order (lang, h, w).

    The first weights are those of the uniform share, already times it, at h = 0."""
    parts = counts.count() // PART_ROWS + 1  # these tables are small beside the texts: no more partitions than they fill
    by_order = {ORDER: counts.coalesce(parts)}
    for n in range(ORDER - 1, 0, -1):  # different tokens before each shorter n-gram
        shorter = by_order[n + 1].groupBy("lang", _suffix("g", n).alias("g")).agg(F.count("*").alias("c"))
        by_order[n] = durable(shorter.coalesce(parts))
    probs, weights = [], []
    for n in range(1, ORDER + 1):
        c = by_language(by_order[n], discounts(by_order[n]))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "g", _shift("g", 16).alias("h"), "c", d.alias("d"))
        sums = c.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"), F.count("*").alias("types"))
        w = F.col("freed") / F.col("total") / (F.col("types") + 1 if n == 1 else F.lit(1))
        seen = c.join(sums, ["lang", "h"]).withColumn("w", w).withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if n == 1:
            p = seen.select("lang", "g", (F.col("own") + F.col("w")).alias("p"))
        else:
            lower = probs[-1].select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
            p = seen.withColumn("s", _suffix("g", n - 1)).join(lower, ["lang", "s"])
            p = p.select("lang", "g", (F.col("own") + F.col("w") * F.col("below")).alias("p"))
        probs.append(durable(p.coalesce(parts)))
        weights.append(durable(sums.select("lang", "h", w.alias("w")).coalesce(parts)))
    return probs, weights


def log_probabilities(asked: DataFrame, probs: list[DataFrame], weights: list[DataFrame]) -> DataFrame:
    """asked: distinct (lang, g).  Returns lang, g, logp for the languages that have a model.

    Most n-grams are found whole; only the others go down to the lower orders."""
    whole = asked.join(probs[-1], ["lang", "g"], "left")
    known, x = whole.where("p IS NOT NULL"), whole.where("p IS NULL").drop("p")
    x = durable(x)
    x = x.coalesce(x.count() // PART_ROWS + 1)
    x = by_language(x, weights[0].select("lang", F.col("w").alias("p")))
    for n in range(1, ORDER):
        seen = probs[n - 1].select("lang", F.col("g").alias("s"), F.col("p").alias("own"))
        x = x.withColumn("s", _suffix("g", n)).join(seen, ["lang", "s"], "left")
        x = x.withColumn("p", F.coalesce("own", "p")).drop("s", "own")
        # the weight that the next longer history leaves to this order
        w = weights[n].select("lang", F.col("h").alias("before"), "w")
        history = _shift(_suffix("g", n + 1) if n + 1 < ORDER else F.col("g"), 16)
        x = x.withColumn("before", history).join(w, ["lang", "before"], "left")
        x = x.withColumn("p", F.col("p") * F.coalesce("w", F.lit(1.0))).drop("before", "w")
    return known.unionByName(x).select("lang", "g", F.log("p").alias("logp"))


def _rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("worst")).where("worst = 1").select("id", F.lit(True).alias("trusted"))
    name = F.when(F.col(lang).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(lang)))
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), name.alias("lang"), half.alias("half"), F.col(text).alias("text"))
    rows = join_small(rows, good, ["id"], "left", F.lit(9))
    return rows.withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each row of ``docs``: id, k (MD5 of language and text), lang, trusted, tokens, logp (sum, null without a model)."""
    rows = _rows(bounded_batches(docs), labels, id_col, text, lang)
    learned = rows.where("trusted").select(F.concat((1 - F.col("half")).cast("string"), "lang").alias("lang"), "text")
    counts = learned.mapInPandas(_counted, "lang string, g long, c long")
    counts = durable(counts.groupBy("lang", "g").agg(F.sum("c").alias("c")))
    probs, weights = kneser_ney(counts)

    size = docs.agg(F.sum(text_bytes(F.col(text)))).first()[0] or 0
    groups = int(size // group_bytes) + 1
    k = F.md5(F.concat_ws("\x00", "lang", F.coalesce("text", F.lit(""))))
    model = F.concat(F.col("half").cast("string"), "lang")  # the model that judges the row: a half and a language
    dealt = rows.select("id", k.alias("k"), model.alias("lang"), "trusted", "text")
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("id", "k"), F.lit(groups)).cast("int"))
    dealt = dealt.mapInPandas(_packed, "id long, k string, lang string, trusted boolean, grp int, blob binary").repartition(groups, "grp")
    asked = stored(dealt.mapInPandas(_asked, "grp int, lang string, g long"), "asked-grams")  # read twice
    answers = log_probabilities(asked.select("lang", "g").distinct(), probs, weights)
    answers = asked.join(answers, ["lang", "g"])
    scored = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(
        _scored, "id long, k string, lang string, trusted boolean, tokens long, logp double"
    )
    return scored.withColumn("lang", F.expr("substr(lang, 2)"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, median and limit (that quantile) of log-perplexity, from the trusted rows of ``scored`` (lang, trusted, lp)."""
    steps = scored.where("trusted AND lp IS NOT NULL").groupBy("lang", F.floor(F.col("lp") * STEP).alias("b")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("lang")  # at most a few ten thousand steps a language
    share = steps.withColumn("upto", F.sum("n").over(of.orderBy("b")) / F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("upto") >= q, (F.col("b") + 1) / F.lit(STEP)))
    return share.groupBy("lang").agg(at(0.5).alias("median"), at(quantile).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each row of ``docs``: id, k, lang, perplexity, threshold, keep."""
    scored = durable(score(docs, labels, id_col, text, lang, group_bytes).withColumn("lp", -F.col("logp") / F.col("tokens")))
    middle = thresholds(scored).select("lang", "median")
    few = F.greatest(F.lit(0), F.lit(SHORT) - F.col("tokens"))
    steady = (F.col("lp") * F.col("tokens") + F.col("median") * few) / (F.col("tokens") + few)
    scored = by_language(scored, middle, "left").withColumn("lp", steady).drop("median")
    limits = thresholds(scored, quantile).select("lang", "limit")
    judged = by_language(scored, limits, "left")
    return judged.select(
        F.col("id").alias(id_col), "k", F.expr("nullif(substr(lang, 2), '')").alias("lang"),
        F.exp("lp").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("lp") <= F.col("limit"), F.lit(True)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    judged = classify(docs, labels, id_col, text, lang)
    bad = judged.where("NOT keep").select("k").distinct()
    name = F.when(F.col(lang).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(lang)))
    k = F.md5(F.concat_ws("\x00", name, F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), k.alias("k"))
    return join_small(rows, bad, ["k"], "left_anti", F.lit(40)).select("row.*")

"""URL filters: sort-merge range join of urls with host/path prefix rules.

A host is canonicalised by reversing its labels, so "host and all subdomains"
becomes a key prefix, i.e. an interval of sorted keys.  A url is listed once for
each label depth that some rule has (``a.b.com`` under ``com``, ``com.b``, ...),
together with its path; rules and urls of one reversed host are sorted by path,
and a sweep keeps the stack of rules whose path interval is open.  The top of
the stack is the longest rule of that host; the longest over the depths wins.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits no rule.  A rule with a null host or verdict is ignored, a null rule path
is empty.  Of equal rules with different verdicts ``block`` wins.  Repeated rows
and null ids are kept as they are; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SWEPT = "host string, path string, rule_host string, rule_path string, verdict string"


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw_host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw_host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, salt, path, rules first): give each url the innermost open rule."""
    group, stack = None, []
    for pdf in frames:
        out = []
        for key, salt, path, is_url, host, verdict in zip(
            pdf["key"], pdf["salt"], pdf["path"], pdf["is_url"], pdf["host"], pdf["verdict"], strict=True
        ):
            if group != (key, salt):
                group, stack = (key, salt), []
            while stack and not path.startswith(stack[-1][1]):
                stack.pop()
            if not is_url:
                stack.append((host, path, verdict))
            elif stack:
                out.append((host, path, *stack[-1]))
        yield pd.DataFrame(out, columns=["host", "path", "rule_host", "rule_path", "verdict"])


def match_rules(urls: DataFrame, rules: DataFrame, salts: int = 64) -> DataFrame:
    """The longest rule for each distinct (host, path) of ``urls`` that fits one.

    urls: host, path.  rules: host, path, verdict.  A reversed host with very
    many urls is spread over ``salts`` sweeps, and its rules go to each of them.
    Returns host, path, rule, verdict."""
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .withColumn("key", _reversed(F.col("host")))
    )
    depth = F.size(F.split("host", r"\.", -1))
    depths = sorted(r[0] for r in rules.select(depth).distinct().collect())  # label counts: at most a few dozen integers
    if not depths:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    labels = F.split("host", r"\.", -1)
    under = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size(labels))
    key = F.transform(under, lambda d: F.array_join(F.slice(F.reverse(labels), F.lit(1), d), "."))
    listed = (
        urls.select("host", "path").where("host != ''").distinct()
        .select("host", "path", F.explode(key).alias("key"))
        .join(rules.select("key").distinct(), "key", "left_semi")
        .select("key", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), "path",
                F.lit(True).alias("is_url"), "host", F.lit(None).cast("string").alias("verdict"))
    )
    spread = rules.select(
        "key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "path", F.lit(False).alias("is_url"), "host", "verdict"
    )
    swept = (
        listed.unionByName(spread).repartition("key", "salt")
        .sortWithinPartitions("key", "salt", "path", "is_url")
        .mapInPandas(sweep, SWEPT)
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), F.col("verdict"))).alias("best")
    return swept.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row: id, host, path, rule (null where none fits), verdict (then ``default``)."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    return urls.join(match_rules(urls, rules), ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )

"""Line dedup by site-relative frequency.

Rows are grouped by host; for each line the number of the host's pages that hold
it is divided by the host's page total, and lines above the boilerplate ratio
are dropped from every page of that host.  Lines are compared trimmed, by their
MD5; blank lines are never dropped.

A page counts once for a line, however often it repeats it; counts are summed
before the shuffle, so a line or a host with a third of all rows is one small
partial count in each task.  A host has at most (lines a page) / ratio
boilerplate lines; that table is measured, then broadcast or joined by shuffle.

Defined cases: a null text stays null and counts as a page without lines; a null
host is a host of its own; a text of which all lines go becomes empty and the
row stays.  A line that fewer than ``min_pages`` pages hold is repeated nowhere and
stays.  Repeated rows count as pages of their own.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.llm.common import join_small

RATIO, MIN_PAGES = 0.05, 2


def _line_keys(text) -> F.Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.md5(F.trim(x)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages: host, text.  Returns host, line (MD5 of the trimmed line), pages, host_pages."""
    keys = F.array_distinct(_line_keys(F.col("text")))
    counted = pages.select("host", F.explode(keys).alias("line")).where(F.col("line") != F.md5(F.lit("")))
    held = counted.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_pages"))
    return (
        held.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
        .where(F.col("pages") / F.col("host_pages") > ratio)
        .select("host", "line", "pages", "host_pages")
    )


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and n_lines, n_dropped (int)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    site = F.when(F.col(host).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(host).cast("string")))
    rows = docs.select(F.struct(*kept).alias("row"), site.alias("host"), F.col(text).alias("text"))
    found = boilerplate(rows.select("host", "text"), ratio, min_pages)
    drops = found.groupBy("host").agg(F.collect_list("line").alias("drops"))
    rows = join_small(rows, drops, ["host"], "left", F.size("drops") * 40 + 40)
    # a host's boilerplate is a short list: at most (lines a page) / ratio entries
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("drops"), F.md5(F.trim(x))))
    left = F.when(F.col("drops").isNull(), lines).otherwise(left)
    rows = rows.withColumn("lines", lines).withColumn("left", left)
    named = [F.array_join("left", "\n").alias(text) if c == text else F.col("row")[c].alias(c) for c in kept]
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n)
    gone = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left"))
    return rows.select(*named, n.cast("int").alias("n_lines"), gone.cast("int").alias("n_dropped"))

"""Events in closed time windows of any ends (EXISTS / COUNT over a time range, by key).

The windows of ``funnel`` open at midnight, so counts a day decide them.  Here both ends
are any instants: time is cut into bins, a window is joined with the bins it touches,
and an event with the bin it lies in.  Bins inside a window count as a whole; in the
two at its ends each instant is compared.  The join is on (keys, bin) only, so it is
never a nested loop, and a key with a third of all events is as many join keys as it
has bins.  Events of one instant are one row before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanlens.functions.joins import free_names

DAY_MICROS = 86_400_000_000


def _bin(col: Column, micros: int) -> Column:
    """Number of the bin that an instant lies in."""
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.floor(since / F.lit(micros)).cast("bigint") if micros > 1 else since


def counted_in_windows(events: DataFrame, windows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", ts: str = "ts", count: str = "events", bin_micros: int = DAY_MICROS) -> DataFrame:
    """``windows`` with ``count``: the events of equal ``keys`` (nulls included) with ``lo`` <= ``ts`` <= ``hi``.

    A window with a null end, or one that ends before it begins, holds nothing.  Equal
    windows are counted each.  ``bin_micros``: length of a bin; about the length of a
    window, or shorter where a bin of one key holds many events."""
    of, at, n, whole, row = free_names(windows, ["w", "bin", "n", "whole", "row"])
    wide = windows.withColumn(row, F.struct(*windows.columns))
    distinct = wide.groupBy(row).agg(F.count("*").alias(of))  # equal windows are looked up once
    ends = [F.col(row)[c].alias(c) for c in (*keys, lo, hi)]
    spans = distinct.select(row, of, *ends).where(F.col(lo) <= F.col(hi))
    first, last = _bin(F.col(lo), bin_micros), _bin(F.col(hi), bin_micros)
    spans = spans.select("*", F.explode(F.sequence(first, last)).alias(at), first.alias(f"{at}_0"), last.alias(f"{at}_1"))
    spans = spans.withColumn(whole, (F.col(at) > F.col(f"{at}_0")) & (F.col(at) < F.col(f"{at}_1")))
    names = [f"{at}_{k}" for k in keys]
    seen = events.where(F.col(ts).isNotNull()).groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(ts).alias(f"{at}_ts")).agg(F.count("*").alias(n))
    seen = seen.withColumn(f"{at}_at", _bin(F.col(f"{at}_ts"), bin_micros))
    same = [spans[k].eqNullSafe(seen[a]) for k, a in zip(keys, names, strict=True)] + [spans[at] == seen[f"{at}_at"]]
    # edges compare instants; inner bins are summed before they meet the windows
    edge = spans.where(~F.col(whole)).join(seen, same).where(F.col(f"{at}_ts").between(F.col(lo), F.col(hi))).select(row, n)
    sums = seen.groupBy(*names, f"{at}_at").agg(F.sum(n).alias(n))
    inner = spans.where(whole)
    same = [inner[k].eqNullSafe(sums[a]) for k, a in zip(keys, names, strict=True)] + [inner[at] == sums[f"{at}_at"]]
    inner = inner.join(sums, same).select(row, n)
    found = edge.unionByName(inner).groupBy(F.col(row).alias(f"{row}_")).agg(F.sum(n).alias(n))
    every = distinct.join(found, distinct[row].eqNullSafe(found[f"{row}_"]), "left")
    every = every.withColumn(of, F.explode(F.array_repeat(F.lit(0), F.col(of).cast("int"))))
    return every.select(*[F.col(row)[c].alias(c) for c in windows.columns if c != count], F.coalesce(n, F.lit(0).cast("bigint")).alias(count))


def exists_in_window(events: DataFrame, windows: DataFrame, keys: list[str], **kw) -> DataFrame:
    """The rows of ``windows`` that hold an event (a semi-join with a time range)."""
    (count,) = free_names(windows, ["events"])
    return counted_in_windows(events, windows, keys, count=count, **kw).where(F.col(count) > 0).select(*windows.columns)


def windows_from_first_event(pairs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A window a pair, from its first event: (uid, entity, first_month, lo, hi); ``lo`` and ``hi`` are intervals."""
    return pairs.select("uid", "entity", "first_month", (F.col("first_ts") + lo).alias("lo"), (F.col("first_ts") + hi).alias("hi"))


def _seen_once(ia: DataFrame, pairs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(uid, entity, first_month, n): pairs that have events in their window, and how many.

    A pair has one window, so bins are as long as it: it touches two, and no event meets
    it twice.  Pairs are unique, so a window needs no look-up before or after the join."""
    t0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    length = pairs.sparkSession.range(1, numPartitions=1).select(F.timestamp_diff("MICROSECOND", t0 + lo, t0 + hi)).first()[0]
    micros = max(length, 1)
    spans = windows_from_first_event(pairs, lo, hi).where("lo <= hi")
    spans = spans.select("*", F.explode(F.sequence(_bin(F.col("lo"), micros), _bin(F.col("hi"), micros))).alias("bin"))
    seen = ia.where("ts IS NOT NULL").groupBy(F.col("uid").alias("u"), F.col("entity").alias("e"), "ts").agg(F.count("*").alias("n"))
    seen = seen.withColumn("at", _bin(F.col("ts"), micros))
    same = [spans["uid"].eqNullSafe(seen["u"]), spans["entity"].eqNullSafe(seen["e"]), spans["bin"] == seen["at"]]
    met = spans.join(seen, same).where("ts BETWEEN lo AND hi")
    return met.groupBy("uid", "entity", "first_month").agg(F.sum("n").alias("n"))


def users_back(ia: DataFrame, pairs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(entity, month, users): pairs with an event from ``lo`` to ``hi`` after their first one, by first period.

    D14 / D15 with windows that open at the first event instead of at the start of its month."""
    back = _seen_once(ia, pairs, lo, hi)
    return back.groupBy("entity", F.col("first_month").alias("month")).agg(F.count("*").alias("users"))


def events_after(ia: DataFrame, pairs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(entity, month, revenue): events of the pairs in those windows."""
    found = counted_in_windows(ia, windows_from_first_event(pairs, lo, hi), ["uid", "entity"])
    return found.groupBy("entity", F.col("first_month").alias("month")).agg(F.sum("events").alias("revenue"))

"""Stored tables that follow the log: roll-ups, user bitmaps, the stream into them, stored dims."""

import os
import random
import re

import pytest
from conftest import SF_MID, SF_SMALL, ts
from pyspark.sql import functions as F

from fanlens.operators import bitmaps, ingest, maintained
from fanlens.operators.maintained import MaintainedLog
from fanlens.plans.model import AudienceModel
from fanlens.sources import dim_store, partitions
from fanlens.sources.interactions import FIXTURES, INTERACTION_SCHEMA
from fanlens.streaming.append import stream_into


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _log(spark, rows):
    return spark.createDataFrame([(u, e, ts(t) if t else None) for u, e, t in rows], INTERACTION_SCHEMA)


FIRST = [(1, 1, "2024-01-05 00:00:00"), (1, 1, "2024-01-05 00:00:00"), (2, 1, "2024-01-31 23:59:59"), (2, 2, "2024-02-01 00:00:00"), (3, 2, "2024-03-10 12:00:00")]
MORE = [(3, 2, "2024-03-10 12:00:00"), (3, 2, "2024-03-11 12:00:00"), (1, 1, "2024-03-01 00:00:00"), (4, 1, "2024-04-01 08:00:00"), (4, 1, "2024-04-01 08:00:00")]


def _equals_rebuild(store, spark, log):
    want, got = AudienceModel(log, persist=False), store.model()
    for name in ("pair_days", "pair_months", "acquisition", "cohort_retention", "active_layers", "entity_active_layers", "aarrr_metrics", "rfm_user", "flow_source", "flow_target"):
        cols = getattr(want, name).columns
        assert _rows(getattr(got, name).select(*cols)) == _rows(getattr(want, name)), name
    got.release()


def test_appends_equal_a_full_rebuild(spark, tmp_path):
    store = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    assert store.append(_log(spark, FIRST)) == 5
    assert store.append(_log(spark, MORE)) == 4  # one event is there already
    assert store.append(_log(spark, MORE)) == 0
    assert store.append(_log(spark, [])) == 0
    assert _rows(store.log().select("uid", "entity", "ts")) == _rows(_log(spark, FIRST + MORE[1:]))
    _equals_rebuild(store, spark, _log(spark, FIRST + MORE[1:]))
    sets = bitmaps.counted(store.users.sets(), ["month", "entity"])
    assert {(r.month.month, r.entity): r.users for r in sets.collect()} == {(1, 1): 2, (2, 2): 1, (3, 2): 1, (3, 1): 1, (4, 1): 1}


def test_append_rewrites_the_months_of_the_batch_only(spark, tmp_path):
    store = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    store.append(_log(spark, FIRST))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet") and "month=" in d}

    before = files()
    store.append(_log(spark, MORE))
    after = files()
    gone = {re.search(r"(\w+)/month=(\d{4}-\d\d)", f).groups() for f in before - after}
    assert gone == {("pair_days", "2024-03"), ("pair_months", "2024-03"), ("user_sets", "2024-03")}  # the log keeps its files
    new = {re.search(r"month=(\d{4}-\d\d)", f).group(1) for f in after - before}
    assert new == {"2024-03", "2024-04"}


def test_relations_do_not_scan_the_log(spark, tmp_path):
    store = MaintainedLog(spark, str(tmp_path))
    store.append(_log(spark, FIRST))
    store.append(_log(spark, MORE))
    m = AudienceModel(store.log(), roll_ups=(store.pair_days(), store.pair_months()), persist=False)
    for name in ("acquisition", "cohort_retention", "active_layers", "aarrr_metrics"):
        read = {f.split(str(tmp_path))[1].split("/")[1] for f in getattr(m, name).inputFiles()}
        assert read and read <= {"pair_days", "pair_months"}, name
    # an append reads the batch's months of the log and of the roll-up
    merged = maintained.merge_days(store.pair_days().where(maintained.in_months([ts("2024-03-01 00:00:00")])), maintained.roll_up(_log(spark, MORE)))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month[^\]]*2024-03-01", plan)


@pytest.mark.parametrize("step", ["log", "days", "swap", "months", "delete"])
def test_a_batch_that_was_cut_off_counts_once(spark, tmp_path, monkeypatch, step):
    store = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    store.append(_log(spark, FIRST))

    class Lost(Exception):
        pass

    def fail(*_args, **_kw):
        raise Lost

    write, replace, finish = partitions.write_partitions, partitions.replace_partitions, partitions.finish
    with monkeypatch.context() as patch:
        if step == "log":  # nothing after the staged rows
            patch.setattr(partitions, "write_partitions", fail)
        elif step == "days":  # the log has the rows
            patch.setattr(partitions, "replace_partitions", fail)
        elif step == "swap":  # the roll-up is staged, not swapped in
            patch.setattr(partitions, "finish", lambda *a: fail() if partitions.exists(spark, f"{a[1]}.staged") else finish(*a))
        elif step == "months":  # the first roll-up is in place
            patch.setattr(partitions, "replace_partitions", lambda df, path, by: fail() if path == store.months_path else replace(df, path, by))
        else:
            patch.setattr(partitions, "delete", lambda s, path: fail() if path == store.staged_path else None)
        with pytest.raises(Lost):
            store.append(_log(spark, MORE))
    assert write is partitions.write_partitions
    again = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    assert again.append(_log(spark, MORE)) == 0  # recovered first, so nothing is new
    assert _rows(again.log().select("uid", "entity", "ts")) == _rows(_log(spark, FIRST + MORE[1:]))
    _equals_rebuild(again, spark, _log(spark, FIRST + MORE[1:]))
    assert bitmaps.counted(again.users.sets().select("bucket", "bits", F.lit(1).alias("all")), ["all"]).first().users == 4


def test_rows_with_nulls_are_kept(spark, tmp_path):
    rows = [(None, 1, "2024-01-01 00:00:00"), (1, None, "2024-01-01 00:00:00"), (1, 1, None), (1, 1, None)]
    store = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    assert store.append(_log(spark, rows)) == 4
    assert store.append(_log(spark, rows)) == 0
    assert _rows(store.log().select("uid", "entity", "ts")) == _rows(_log(spark, rows))
    assert store.pair_days().count() == 3


def test_partial_log_write_is_completed_row_by_row(spark):
    log = _log(spark, FIRST).withColumn("month", F.lit(ts("2024-01-01 00:00:00")))
    staged = _log(spark, [FIRST[0]] * 3 + [(9, 9, "2024-01-09 00:00:00")]).withColumn("month", F.lit(ts("2024-01-01 00:00:00")))
    assert _rows(maintained.lacking(log, staged).select("uid")) == [(1,), (9,)]


# --- bitmaps and sketches -----------------------------------------------------------


def test_counts_of_any_range_of_months_equal_the_exact_count(spark):
    from fanlens.plans.queries_store import _maintained

    store, m = _maintained(spark, SF_SMALL)
    sets = store.users.sets().cache()
    months = sorted(r.month for r in sets.select("month").distinct().collect())
    log = FIXTURES["f1"](spark, SF_SMALL).withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz")).cache()
    rng = random.Random(5)
    for _ in range(6):
        a, b = sorted(rng.sample(range(len(months)), 2))
        got = bitmaps.counted(bitmaps.month_range(sets, str(months[a]), str(months[b])).withColumn("all", F.lit(1)), ["all"]).first().users
        assert got == log.where(F.col("month").between(F.lit(months[a]), F.lit(months[b]))).select("uid").distinct().count()
    assert store.users.dictionary().agg(F.countDistinct("number"), F.max("number")).first()[:] == (150, 149)


def test_bitmap_counts_shuffle_no_users(spark):
    from fanlens.plans.queries_store import _maintained, a44_bitmaps, d31_bitmaps

    store, m = _maintained(spark, SF_SMALL)
    for query in (a44_bitmaps, d31_bitmaps):
        counts = query(store, m)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "uid" not in plan and "bitmap_or_agg" in plan
        assert all("/user_sets/" in f for f in counts.inputFiles())


def test_dictionary_grows_without_renumbering(spark, tmp_path):
    store = MaintainedLog(spark, str(tmp_path), with_bitmaps=True, hash_ranges=4)
    store.append(_log(spark, FIRST))
    before = {r.uid: r.number for r in store.users.dictionary().collect()}
    store.append(_log(spark, MORE))
    after = {r.uid: r.number for r in store.users.dictionary().collect()}
    assert {u: after[u] for u in before} == before and sorted(after.values()) == list(range(4))


def test_sets_cross_bitmap_borders(spark):
    rows = spark.range(70_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("number"))
    sets = bitmaps.user_sets(rows, ["g"])
    assert sets.select("bucket").distinct().count() >= 3
    assert {r.g: r.users for r in bitmaps.counted(sets, ["g"]).collect()} == {0: 23_334, 1: 23_333, 2: 23_333}
    assert bitmaps.counted(sets.withColumn("all", F.lit(0)), ["all"]).first().users == 70_000


def test_sketch_error_is_within_its_bound(spark):
    ma = AudienceModel(FIXTURES["f1"](spark, SF_MID)).monthly_active
    exact = {(r.month, r.entity): r.n for r in ma.groupBy("month", "entity").agg(F.countDistinct("uid").alias("n")).collect()}
    kept = bitmaps.sketches(ma, ["month", "entity"])
    got = bitmaps.estimated(kept, ["month", "entity"]).collect()
    assert {(r.month, r.entity) for r in got} == set(exact)
    assert max(abs(r.users - exact[r.month, r.entity]) / exact[r.month, r.entity] for r in got) < 0.05
    users = bitmaps.estimated(kept.withColumn("all", F.lit(0)), ["all"]).first().users
    assert abs(users - 1500) / 1500 < 4 * 1.04 / 2 ** (bitmaps.LG_K / 2)


# --- the stream -----------------------------------------------------------------------


def _land(spark, rows, landing, at):
    feed = ingest.render_feed(_log(spark, rows)).coalesce(1)
    feed.write.mode("append").json(os.path.join(landing, f"pull={at}"))


def test_stream_drops_repeats_in_state_and_older_ones_against_the_log(spark, tmp_path):
    landing, ckpt = str(tmp_path / "landing"), str(tmp_path / "ckpt")
    store = MaintainedLog(spark, str(tmp_path / "store"))
    store.append(_log(spark, [FIRST[2], FIRST[4]]))  # there before the stream began
    met = []

    def append(batch):
        met.append(batch.count())
        return store.append(batch)

    _land(spark, FIRST[1:4], landing, 1)
    stream_into(spark, f"{landing}/*", append, ckpt, "1 hour", max_files=1)
    _land(spark, FIRST[1:5] + MORE[1:3], landing, 2)  # a pull returns everything again
    stream_into(spark, f"{landing}/*", append, ckpt, "1 hour", max_files=1)
    assert sum(met) == 6  # three events, then the three that state does not know
    want = FIRST[1:5] + MORE[1:3]
    assert _rows(store.log().select("uid", "entity", "ts")) == _rows(_log(spark, want))
    _equals_rebuild(store, spark, _log(spark, want))
    # an event of any age that comes for the first time is not late
    _land(spark, [(7, 1, "1999-01-01 00:00:00")], landing, 3)
    stream_into(spark, f"{landing}/*", append, ckpt, "1 hour", max_files=1)
    assert store.log().where("uid = 7").count() == 1


def test_stream_that_fails_in_a_batch_goes_on_from_its_checkpoint(spark, tmp_path):
    landing, ckpt = str(tmp_path / "landing"), str(tmp_path / "ckpt")
    store = MaintainedLog(spark, str(tmp_path / "store"))
    _land(spark, FIRST[1:], landing, 1)

    def lost(batch):
        store.append(batch)
        raise RuntimeError("lost after the append, before the batch was committed")

    with pytest.raises(Exception, match="lost after the append"):
        stream_into(spark, f"{landing}/*", lost, ckpt, "1 hour")
    stream_into(spark, f"{landing}/*", store.append, ckpt, "1 hour")
    assert _rows(store.log().select("uid", "entity", "ts")) == _rows(_log(spark, FIRST[1:]))


def test_state_forgets_after_the_delay_and_the_log_remembers(spark, tmp_path):
    import time

    landing, ckpt = str(tmp_path / "landing"), str(tmp_path / "ckpt")
    store, met = MaintainedLog(spark, str(tmp_path / "store")), []

    def append(batch):
        met.append(batch.count())
        return store.append(batch)

    for pull in range(3):
        _land(spark, FIRST[1:3], landing, pull)
        stream_into(spark, f"{landing}/*", append, ckpt, "1 second")
        time.sleep(2)
    assert sum(met) > 2  # state let the events through again
    assert _rows(store.log().select("uid", "entity", "ts")) == _rows(_log(spark, FIRST[1:3]))


# --- stored dims ------------------------------------------------------------------------


def _names(spark, rows):
    return spark.createDataFrame(rows, "entity long, name string, at long")


def test_upserts_of_a_stored_dim(spark, tmp_path):
    path = str(tmp_path / "dim")
    dim = dim_store.entity_dim(spark, path, buckets=8)
    assert dim.read().count() == 0
    assert dim.upsert(_names(spark, [(k, f"n{k}", 0) for k in range(40)] + [(3, "late", 1)]), "at") == 40

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    def bucket(f):
        return re.search(r"bucket=(\d+)", f).group(1)

    first = files()
    assert len({bucket(f) for f in first}) == 8
    assert dim.upsert(_names(spark, [(5, "five", 0), (5, "n5", 2), (3, "late", 0)]), "at") == 0  # what is stored already
    assert files() == first
    assert dim_store.entity_dim(spark, path, buckets=8).upsert(_names(spark, [(5, "five", 0), (6, "n6", 0), (41, None, 0)]), "at") == 2
    touched = {bucket(f) for f in first ^ files()}
    of = {r.entity: str(r.b) for r in spark.createDataFrame([(5,), (41,)], "entity long").select("entity", F.pmod(F.xxhash64("entity"), F.lit(8)).alias("b")).collect()}
    assert touched == set(of.values())
    got = {r.entity: r.name for r in dim.read().collect()}
    assert got == {**{k: f"n{k}" for k in range(40)}, 3: "late", 5: "five", 41: None}


def test_upsert_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dim")
    dim = dim_store.entity_dim(spark, path, buckets=2)
    dim.upsert(_names(spark, [(1, "a", 0), (2, "b", 0), (None, "nobody", 0)]), "at")
    with monkeypatch.context() as patch:
        finish = partitions.finish
        patch.setattr(partitions, "finish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")) if partitions.exists(spark, f"{path}.staged") else finish(*a))
        with pytest.raises(RuntimeError, match="lost"):
            dim.upsert(_names(spark, [(1, "aa", 0), (None, "somebody", 0)]), "at")
    assert _rows(dim.read()) == _rows(_names(spark, [(1, "a", 0), (2, "b", 0), (None, "nobody", 0)]).drop("at"))
    assert dim.upsert(_names(spark, [(2, "b", 0)]), "at") == 0
    assert _rows(dim.read()) == _rows(_names(spark, [(1, "aa", 0), (2, "b", 0), (None, "somebody", 0)]).drop("at"))


# --- what an append and its sets move ------------------------------------------------


def test_a_bitmap_is_made_after_its_rows_have_met(spark):
    rows = spark.range(0, 100_000, 1, 8).select((F.col("id") % 3).alias("g"), (F.col("id") % 70_000).alias("number"))
    sets = bitmaps.user_sets(rows, ["g"])
    plan = sets._jdf.queryExecution().sparkPlan().toString() + sets._jdf.queryExecution().executedPlan().toString()
    last = plan.split("AdaptiveSparkPlan")[-1]
    assert last.rindex("bitmap_construct_agg") < last.index("Exchange")  # no task sends a bitmap begun on its own rows
    got = {r.g: r.users for r in bitmaps.counted(sets, ["g"]).collect()}
    assert got == {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("number").alias("n")).collect()}


def test_an_append_reads_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    log = _log(spark, FIRST + MORE)
    batch = log.mapInPandas(counted, log.schema)
    store = MaintainedLog(spark, str(tmp_path))
    assert store.append(batch) == len(FIRST + MORE)
    assert seen.value == len(FIRST + MORE)


def test_swapping_in_a_replacement_shuffles_nothing(spark, tmp_path):
    shuffled = []
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", (F.col("id") % 3).alias("p"))
    partitions.replace_partitions(df, path, "p")
    partitions.write_partitions(df.withColumn("id", F.col("id") + 1000).where("p = 1"), f"{path}.staged", "p")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "hint", lambda self, name, *cols: shuffled.append(name) or self)
        assert partitions.finish(spark, path, df.schema, "p")
    assert not shuffled
    got = spark.read.schema(df.schema).parquet(path)
    assert {r.p: (r.n, r.lo) for r in got.groupBy("p").agg(F.count("*").alias("n"), F.min("id").alias("lo")).collect()} == {0: (34, 0), 1: (33, 1001), 2: (33, 2)}

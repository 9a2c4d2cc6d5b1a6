"""Dimension helpers: VALUES source, primary-key check, INSERT OR REPLACE upsert."""

import pytest

from conftest import SF_SMALL
from fanlens.sources import dims


def test_upsert_replaces_by_key_and_last_update_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], dims.ENTITY_SCHEMA)
    upd = spark.createDataFrame([(2, "B2", 9), (3, "c", 2), (2, "B1", 1)], "entity long, name string, seen int")
    got = sorted(tuple(r) for r in dims.upsert(base, upd.repartition(3), "entity", "seen").collect())
    assert got == [(1, "a"), (2, "B2"), (3, "c")]


def test_values_source_and_pk_check(spark):
    dim = dims.entity_dim_from_rows(spark, [(5, "x"), (5, "y"), (-3, "roaming")])
    assert sorted(tuple(r) for r in dim.collect()) == [(-3, "roaming"), (5, "y")]
    dims.assert_unique(dim, "entity")
    with pytest.raises(ValueError):
        dims.assert_unique(spark.createDataFrame([(1, "a"), (1, "b")], dims.ENTITY_SCHEMA), "entity")


def test_nation_dim_is_keyed(spark):
    dim = dims.nation_entities(spark, SF_SMALL)
    dims.assert_unique(dim, "entity")
    assert dim.filter("entity <= 0").count() == 0
    assert sorted(r[0] for r in dims.segment_dim(spark).collect()) == [-3, -2, -1]

"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the whole test tables through a fixture (F1 by default) and
the shared ``AudienceModel`` of that fixture.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from fanlens.params import Params
from fanlens.plans import oracle
from fanlens.plans.model import AudienceModel, model_for


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    on_model: Callable[[AudienceModel], DataFrame] | None = None
    final_sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, final_sql: str | None, fixture: str = "f1", params: Params = Params()):
    """Decorator for ``fn(model) -> DataFrame``; ``final_sql`` is the oracle's last SELECT."""

    def deco(fn: Callable[[AudienceModel], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(model_for(spark, sf_dir, fixture, params))

        q = oracle.sql(final_sql, fixture, params.grain, params.sentinel) if final_sql is not None else None
        REGISTRY[name] = Query(name, build, q, on_model=fn, final_sql=final_sql)
        return fn

    return deco


def register_raw(name: str, oracle_sql: str | None):
    """Decorator for ``fn(spark, sf_dir) -> DataFrame`` with a complete oracle query."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(name, fn, oracle_sql)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from fanlens.plans import queries_batch, queries_select, queries_extra, queries_params, queries_store  # noqa: F401

    return REGISTRY

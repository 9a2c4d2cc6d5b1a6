"""Selections of entities and optional predicates.

A selection is ``None`` (everything), a list of ids, or a frame with an
``entity`` column.  Frames are joined (semi, anti or marked), so a selection of
any size stays distributed; lists become ``IN`` predicates that reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Selection = DataFrame | Sequence[int] | None

#: ids of a selection that are looked up once and become an ``IN`` list
SMALL_SELECTION = 1_000


def resolved(sel: DataFrame, most: int = SMALL_SELECTION) -> Selection:
    """A selection of up to ``most`` ids as a list, a larger one as the frame it is.

    One bounded look-up; readings that use a selection several times then filter
    instead of joining each time."""
    rows = sel.select("entity").where("entity IS NOT NULL").distinct().limit(most + 1).collect()
    return sorted(r["entity"] for r in rows) if len(rows) <= most else sel


def _ids(sel: DataFrame, col: str) -> DataFrame:
    return sel.select(F.col("entity").alias(col)).distinct()


def keep_selected(df: DataFrame, col: str, sel: Selection) -> DataFrame:
    """Rows whose ``col`` is selected."""
    if isinstance(sel, DataFrame):
        return df.join(_ids(sel, col), col, "left_semi")
    return df.filter(entity_filter(col, sel))


def drop_selected(df: DataFrame, col: str, sel: Selection) -> DataFrame:
    """Rows whose ``col`` is not selected."""
    if isinstance(sel, DataFrame):
        return df.join(_ids(sel, col), col, "left_anti")
    return df.filter(~entity_filter(col, sel))


def mark_selected(df: DataFrame, col: str, sel: Selection, flag: str) -> DataFrame:
    """All rows, with a boolean ``flag`` for the selected ones."""
    if isinstance(sel, DataFrame):
        marked = _ids(sel, col).withColumn(flag, F.lit(True))
        return df.join(marked, col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return df.withColumn(flag, entity_filter(col, sel))


def entity_filter(col, ids: Sequence[int] | None) -> Column:
    """Membership in a list of ids; ``None`` means "no selection" (always true)."""
    c = F.col(col) if isinstance(col, str) else col
    if ids is None:
        return F.lit(True)
    ids = [int(i) for i in ids]
    if not ids:
        return F.lit(False)
    return c.isin(ids)


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of optional predicates (empty -> true)."""
    conditions = list(conditions)
    if not conditions:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conditions)

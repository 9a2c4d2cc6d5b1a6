"""Registered queries with other parameters: grains, sentinel, windows that open at the first event."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanlens.operators import intervals
from fanlens.params import Params
from fanlens.plans.registry import register

#: weeks of the sub-day log, with another pseudo-entity
WEEK = Params(grain="week", sentinel=-9)
QUARTER = Params(grain="quarter")

_RELATIONS = {
    "d02_interactions": ("SELECT uid, entity, ts, month FROM ev", "events"),
    "d03_first_touch": ("SELECT uid, entity, month FROM ft", "first_touch"),
    "d06_pair_label": ("SELECT uid, entity, label FROM lbl", "pair_label"),
    "d08_pair_label_augmented": ("SELECT uid, entity, label FROM aug", "pair_label_augmented"),
    "d09_flow_source": ("SELECT uid, target, month, source FROM fs", "flow_source"),
    "d10_flow_target": ("SELECT uid, source, month, target FROM ftg", "flow_target"),
    "d18_aarrr_metrics": ("SELECT * FROM aarrr", "aarrr_metrics"),
    "d25_cohort_retention": ("SELECT * FROM cohort", "cohort_retention"),
    "d29_active_layers": ("SELECT * FROM layers", "active_layers"),
    "d32_flow_net_churn": ("SELECT * FROM churn", "flow_net_churn"),
}
for _name, (_sql, _relation) in _RELATIONS.items():
    for _suffix, _fixture, _params in (("week", "f3", WEEK), ("quarter", "f1", QUARTER)):
        register(f"{_name}_{_suffix}", _sql, _fixture, _params)(lambda m, relation=_relation: getattr(m, relation))


# --- windows from the first event (D14, D15, D17 without a month's start) ----------
def _from_first(lo: str, hi: str, fixture: str, measure: str) -> str:
    return f"""SELECT entity, month, {measure} FROM (
  SELECT p.uid, p.entity, p.month, count(*) AS n
  FROM (SELECT uid, entity, min(ts) AS first, min(month) AS month FROM ev GROUP BY ALL) p
  JOIN ev e ON e.uid = p.uid AND e.entity = p.entity AND e.ts >= first + INTERVAL {lo} AND e.ts <= first + INTERVAL {hi} GROUP BY ALL) back
GROUP BY ALL"""


@register("d14_activation_first_event", _from_first("1 MICROSECOND", "7 DAY", "f3", "count(*) AS users"), "f3")
def d14_first_event(m):
    """Pairs with a second event within seven days of their first one, to the microsecond."""
    return intervals.users_back(m.ia, m.pairs, F.expr("INTERVAL '0.000001' SECOND"), F.expr("INTERVAL '7' DAY"))


@register("d15_early_retention_first_event", _from_first("27 DAY", "33 DAY", "f1", "count(*) AS users"))
def d15_first_event(m):
    return intervals.users_back(m.ia, m.pairs, F.expr("INTERVAL '27' DAY"), F.expr("INTERVAL '33' DAY"))


@register("d17_revenue_first_event", _from_first("0 DAY", "10 DAY", "f3", "CAST(sum(n) AS BIGINT) AS revenue"), "f3")
def d17_first_event(m):
    return intervals.events_after(m.ia, m.pairs, F.expr("INTERVAL '0' DAY"), F.expr("INTERVAL '10' DAY"))

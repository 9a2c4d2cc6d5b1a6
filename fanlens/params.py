"""Fixed values and tunable parameters.

Fixed values (must equal the behaviour being reproduced):

* ROAMING = -3  — pseudo entity / label for "no home entity" users
* FIXED   = -2  — pair label: loyal to that entity
* FLOWING = -1  — pair label: not loyal
* OTHERS  = -999 — pseudo entity for the "everything else" row of a top-N
* RFM tags, in test order: high_value_loyal (r, f, m >= 4), potential (r, f >= 3),
  churn_risk (r <= 2), regular (else)
* lifecycle stages, in test order: takeoff (seq < t0-2), accelerate (t0-2..t0+2),
  peak_sprint (..t0+6), slowing (..t0+10), pullback_warning (..t0+14), decline
* funnel stages: new, month1_fixed, month2_fixed
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
ROAMING = -3
FIXED = -2
FLOWING = -1
OTHERS = -999

SEGMENT_NAMES = {ROAMING: "roaming", FIXED: "fixed", FLOWING: "flowing"}

RFM_HIGH_VALUE = "high_value_loyal"
RFM_POTENTIAL = "potential"
RFM_CHURN_RISK = "churn_risk"
RFM_REGULAR = "regular"

# bands of the dashboard's readings (fixed values): a share above / below which a word is given
FIXED_SHARE_HEALTHY, FIXED_SHARE_MEDIUM = 0.55, 0.4
ENTITY_SHARE_UNSTABLE, ENTITY_SHARE_CORE = 0.4, 0.7
TOP3_CONCENTRATED, TOP3_SEMI = 0.6, 0.4
CROSS_RATE_HIGH = 0.6
WEAK_SHARE_WATCHING, WEAK_SHARE_BALANCED = 0.6, 0.4
FUNNEL_STEP_WEAK = 0.2
CHURN_BALANCED = 0.03
RETENTION_WEAK = 0.35
HIGH_VALUE_LOW = 0.1
SEGMENT_WEAK = 0.15

# parameter ranges of the interactive controls (fixed values)
TOP_N_RANGE = (3, 15)
CLUSTER_K_RANGE = (2, 10)
MIN_CLUSTER_USERS = 100


def check_range(name: str, value: int, lo: int, hi: int | None = None) -> int:
    """Reject parameters outside the ranges the interactive controls allow."""
    if value < lo or (hi is not None and value > hi):
        bound = f"[{lo}, {hi}]" if hi is not None else f">= {lo}"
        raise ValueError(f"{name}={value} outside {bound}")
    return value


STAGES = ("takeoff", "accelerate", "peak_sprint", "slowing", "pullback_warning", "decline")
FUNNEL_STAGES = ("new", "month1_fixed", "month2_fixed")


@dataclass(frozen=True)
class Params:
    """Grain, sentinel, window lengths and thresholds; defaults equal the reference behaviour.

    ``grain``: the period that ``month`` columns hold the start of, in labels, flows, cohorts,
    layers and funnels.  ``sentinel``: the pseudo-entity of events and flows without a home."""

    grain: str = "month"
    sentinel: int = ROAMING

    activation_days: int = 7
    retention_from_days: int = 27
    retention_to_days: int = 33
    revenue_days: int = 30
    rfm_window_days: int = 90
    label_month_quantile: float = 0.5
    label_recency_quantile: float = 0.75
    rfm_low_quantile: float = 0.2
    rfm_high_quantile: float = 0.8
    growth_min_points: int = 5
    growth_k_factor: float = 1.2
    growth_r_init: float = 0.35
    growth_t0_factor: float = 0.5
    fit_r_init: float = 0.3
    fit_max_evals: int = 5000
    fit_tolerance: float = 1.49e-8
    curve_points: int = 100
    assoc_top_n: int = 8
    cluster_max_users: int | None = None  # all; the interactive control offers a top-n
    cluster_max_iter: int = 300
    cluster_k: int = 4
    cluster_seed: int = 42

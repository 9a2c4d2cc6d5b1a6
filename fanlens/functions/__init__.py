"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from fanlens.functions.time import (  # noqa: F401
    add_days,
    add_months,
    day_diff,
    day_start,
    month_diff,
    month_start,
    to_event_time,
    year_month,
)
from fanlens.functions.math import ratio, safe_ratio, logistic, logistic_slope  # noqa: F401
from fanlens.functions.select import all_of, entity_filter  # noqa: F401

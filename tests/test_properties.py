"""Property tests: the Spark rewrites equal brute-force definitions on random logs.

* flows: "most events with another entity strictly before the first-touch
  month" / "from the next month on", ties to the smallest id — checked
  against the running-maximum timeline rewrite;
* funnel: closed windows [M, M+7d], [M+27d, M+33d], [M, M+30d] on the raw
  timestamps — checked against the day-grain + midnight-count rewrite.
"""

import datetime as dt
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fanlens.params import ROAMING
from fanlens.plans.model import AudienceModel

BASE = dt.datetime(2024, 1, 1)

# events on day offsets 0..150 with a few fixed clock times (midnight included)
event = st.tuples(
    st.integers(1, 4),  # uid
    st.integers(1, 4),  # entity
    st.integers(0, 150),  # day offset
    st.sampled_from([0, 1, 3600 * 12, 86399]),  # seconds into the day
)


def month_start(t: dt.datetime) -> dt.datetime:
    return dt.datetime(t.year, t.month, 1)


def next_month(m: dt.datetime) -> dt.datetime:
    return dt.datetime(m.year + (m.month == 12), m.month % 12 + 1, 1)


def brute(events):
    by_pair = defaultdict(list)
    for u, e, t in events:
        by_pair[(u, e)].append(t)
    first = {p: month_start(min(ts)) for p, ts in by_pair.items()}

    def top(u, exclude, keep):
        c = Counter(e for uu, e, t in events if uu == u and e != exclude and keep(t))
        if not c:
            return ROAMING
        best = max(c.values())
        return min(e for e, n in c.items() if n == best)

    src = {(u, e): top(u, e, lambda t, m=m: t < m) for (u, e), m in first.items()}
    tgt = {(u, e): top(u, e, lambda t, m=m: t >= next_month(m)) for (u, e), m in first.items()}
    fun = {}
    for (u, e), m in first.items():
        ts = by_pair[(u, e)]

        def within(a, b):
            return [t for t in ts if m + dt.timedelta(days=a) <= t <= m + dt.timedelta(days=b)]

        fun[(u, e)] = (bool(within(0, 7)), bool(within(27, 33)), len(within(0, 30)))
    return first, src, tgt, fun


SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(event, min_size=1, max_size=40))
def test_flows_match_definition(make_log, raw):
    events = [(u, e, BASE + dt.timedelta(days=d, seconds=s)) for u, e, d, s in raw]
    ia = make_log([(u, e, t.isoformat(sep=" ")) for u, e, t in events])
    m = AudienceModel(ia, persist=False)
    first, src, tgt, _ = brute(events)
    got_src = {(r["uid"], r["target"]): r["source"] for r in m.flow_source.collect()}
    got_tgt = {(r["uid"], r["source"]): r["target"] for r in m.flow_target.collect()}
    assert got_src == src
    assert got_tgt == tgt


@SETTINGS
@given(st.lists(event, min_size=1, max_size=40))
def test_funnel_windows_match_definition(make_log, raw):
    events = [(u, e, BASE + dt.timedelta(days=d, seconds=s)) for u, e, d, s in raw]
    ia = make_log([(u, e, t.isoformat(sep=" ")) for u, e, t in events])
    m = AudienceModel(ia, persist=False)
    first, _, _, fun = brute(events)
    want = defaultdict(lambda: [0, 0, 0, 0])
    for (u, e), mo in first.items():
        a, r, n = fun[(u, e)]
        w = want[(e, mo)]
        w[0] += 1
        w[1] += a
        w[2] += r
        w[3] += n
    got = {(r["entity"], r["month"]): [r["acq"], r["activ"], r["reten"], r["revenue"]] for r in m.funnel_core.collect()}
    assert got == dict(want)

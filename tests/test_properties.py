"""Randomized checks against brute force on small inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fundscope.functions import columns as C
from fundscope.operators import views as V

STATES = ["successful", "failed", "other", "paused", None]
row = st.tuples(st.sampled_from(["X", "Y", None]), st.sampled_from([2010, 2011, None]),
                st.sampled_from(["a", "b"]), st.sampled_from(STATES))


def _half_up(n, d, scale):
    q, r = divmod(2 * abs(n) * 10 ** scale + abs(d), 2 * abs(d))
    return (q if n * d >= 0 else -q) / 10 ** scale


def _brute(rows):
    counts, totals = {}, {}
    for c, y, m, s in rows:
        if s in ("successful", "failed"):
            counts[(c, y, m, s)] = counts.get((c, y, m, s), 0) + 1
            totals[(c, y, m)] = totals.get((c, y, m), 0) + 1
    rates = {k: (n, totals[k[:3]], _half_up(n * 100, totals[k[:3]], 2)) for k, n in counts.items()}
    cells = {(c, y, m) for c, y, m, s in rows if s is not None and s != "other"}
    full = {}
    for cell in cells:
        for s in ("successful", "failed"):
            hit = rates.get(cell + (s,)) if None not in cell else None
            full[cell + (s,)] = (hit[1], hit[2], cell[1]) if hit else (0, 0.0, None)
    return rates, full


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_success_rates_match_brute_force(spark, rows):
    df = spark.createDataFrame([(i,) + r for i, r in enumerate(rows)],
                               "ID long, country string, launch_year int, main_category string, state_merged string")
    en = df.withColumn("country_code", F.col("country"))
    rates, full = _brute(rows)
    got_rates = {(r.country, r.year, r.main_category, r.state_merged): (r.no_of_projects, r.total_no, r.percentage)
                 for r in V.success_rate(en, ordered=False).collect()}
    assert got_rates == rates
    for by_join in (False, True):
        got = {(r.country, r.year, r.main_category, r.state): (r.total_no, r.percentage, r.test)
               for r in V.success_rate_full(en, by_join=by_join).collect()}
        assert got == full


date_parts = st.tuples(st.integers(0, 32), st.integers(0, 13), st.integers(1890, 2030),
                       st.integers(0, 24), st.integers(0, 60), st.booleans())


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(date_parts, min_size=1, max_size=200))
def test_day_first_parser_matches_python(spark, parts):
    texts = []
    for d, m, y, hh, mi, pad in parts:
        texts.append(f"{d:02d}/{m:02d}/{y} {hh:02d}:{mi:02d}" if pad else f"{d}/{m}/{y} {hh}:{mi}")
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.ts for r in df.select(C.parse_day_first_timestamp("s").alias("ts")).collect()]
    for (d, m, y, hh, mi, _), ts in zip(parts, got):
        try:
            want = dt.datetime(y, m, d, hh, mi)
        except ValueError:
            want = None
        assert ts == want

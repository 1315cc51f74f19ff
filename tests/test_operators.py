"""Operators on small inputs: boundary cases, published numbers, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.operators import compare, dm, features, forecast, grid, metrics, planner, probabilistic, search, splits


def holm(spark, values):
    rows = [(f"m{k}", "x", v) for k, v in enumerate(values)]
    out = dm.holm(spark.createDataFrame(rows, "name string, family string, p_value double"), ["family"], ties=["name"])
    return [r.p_holm for r in out.orderBy("name").collect()]


def test_holm_published_numbers(spark):
    assert holm(spark, [0.75876, 0.03962, 0.05555]) == pytest.approx([0.75876, 0.11886, 0.11886], abs=1.5e-5)
    assert holm(spark, [0.55515, 0.00925, 0.01171]) == pytest.approx([0.55515, 0.02775, 0.02775], abs=1.5e-5)


def test_holm_keeps_nulls_out_of_the_count(spark):
    assert holm(spark, [0.01, None, 0.04]) == [0.02, None, 0.04]


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.07338803), (1.0, 1, 0.5), (2.0, 2, 0.18350342), (0.0, 7, 1.0), (2.0, 53, 0.05064), (3.0, 9, 0.01495636)])
def test_student_t(spark, t, df, p):
    got = spark.range(1).select(dm.t_two_sided(F.lit(t), F.lit(df).cast("long")).alias("p")).first().p
    assert got == pytest.approx(p, abs=5e-6)


def test_dm_statuses(spark):
    rows = [("a", k, 0.0) for k in range(10)] + [("b", k, 1.0) for k in range(3)] + [("c", k, 1.0) for k in range(10)] + [("d", k, float((-1) ** k + 1)) for k in range(10)]
    out = dm.dm_tests(spark.createDataFrame(rows, "g string, day int, d double"), ["g"], "day", lag=0)
    assert {r.g: r.status for r in out.collect()} == {"a": "identical losses", "b": "insufficient sample", "c": "invalid HAC variance", "d": "ok"}


def test_rolling_needs_two_values(spark):
    obs = spark.createDataFrame([("P", k, float(k)) for k in range(4)], "target string, ts int, y double")
    got = features.rolling_features(obs, [24]).orderBy("ts").collect()
    assert [r.rmean_24 for r in got] == [None, 0.0, 0.5, 1.0]
    assert [r.rstd_24 for r in got][:2] == [None, None]


def test_future_does_not_move_a_forecast(spark):
    stamps = [f"2024-01-{d:02d} {h:02d}:00:00" for d in range(1, 11) for h in range(24)]
    rng = random.Random(1)
    base = [("P", s, rng.random()) for s in stamps]
    moved = [(t, s, 9.87654321e12 if s >= "2024-01-09" else y) for t, s, y in base]

    def run(rows):
        obs = spark.createDataFrame(rows, "target string, s string, y double").select("target", F.to_timestamp_ntz("s").alias("ts"), "y")
        points = forecast.all_models(obs, "2024-01-09", "2024-01-09")
        return sorted((r.model_id, r.ts, r.y_pred) for r in points.collect())

    assert run(base) == run(moved)


def test_all_models_is_the_union_of_the_single_ones(spark):
    stamps = [f"2024-01-{d:02d} {h:02d}:00:00" for d in range(1, 12) for h in range(24) if (d, h) not in {(2, 3), (9, 5)}]
    rng = random.Random(4)
    obs = spark.createDataFrame([(t, s, rng.random()) for t in "PQ" for s in stamps], "target string, s string, y double").select("target", F.to_timestamp_ntz("s").alias("ts"), "y")
    parts = [forecast.seasonal_naive(obs, 24), forecast.seasonal_naive(obs, 168), forecast.previous_day_mean(obs), forecast.same_hour_mean(obs), forecast.seasonal_naive(obs, 24, "dup_naive24")]
    single = parts[0]
    for part in parts[1:]:
        single = single.unionByName(part)

    def rows(df):
        return sorted((r.model_id, r.target, r.ts, r.date, r.horizon, round(r.y_pred, 12), round(r.error, 12)) for r in df.collect())

    assert rows(forecast.all_models(obs, "2024-01-08", "2024-01-11")) == rows(forecast.in_period(single, "2024-01-08", "2024-01-11"))


def test_conformal_ranks(spark):
    errors = spark.createDataFrame([("x", float(k)) for k in range(1, 13)], "k string, error double")
    got = probabilistic.conformal_bounds(errors, ["k"], [0.8, 0.95]).orderBy("coverage").collect()
    assert [(r.lower, r.upper) for r in got] == [(1.0, 12.0), (1.0, 12.0)]


def test_crps_of_ensemble_against_all_pairs(spark):
    rng = random.Random(2)
    x, y = [rng.gauss(0, 1) for _ in range(15)], 0.3
    want = sum(abs(v - y) for v in x) / 15 - sum(abs(a - b) for a in x for b in x) / (2 * 15 * 15)
    got = probabilistic.crps_ensemble(spark.createDataFrame([("k", v, y) for v in x], "k string, x double, y double"), ["k"]).first().crps
    assert got == pytest.approx(want)


def test_grid_audit_counts_gaps_and_repeats(spark):
    rows = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) as ts, 1.0D as v from values (0), (1), (1), (4) t(h)")
    got = grid.audit_grid(rows, values=["v"]).first()
    assert (got.n_rows, got.n_hours, got.span_hours, got.missing, got.repeated, got.bad_values) == (4, 3, 5, 2, 1, 0)


def test_seasons_and_leap_days(spark):
    rows = spark.sql("select to_date(d) as d from values ('2023-12-01'), ('2024-02-29'), ('2024-03-01'), ('2024-11-30') t(d)")
    got = calendar.season_features(rows, "d").orderBy("d").collect()
    assert [(r.season_idx, r.day_in_season, r.season_len) for r in got] == [(0, 1, 91), (0, 91, 91), (1, 1, 92), (3, 91, 91)]


def test_summer_time(spark):
    got = spark.sql("select '2021-07-01 00:00:00' as s union all select 'no time'").select(calendar.civil(calendar.fixed_utc2(F.col("s"))).alias("t")).collect()
    assert str(got[0].t) == "2021-07-01 01:00:00"
    assert got[1].t is None


def test_next_midnight(spark):
    rows = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' as t union all select timestamp_ntz '2024-01-01 23:00:00'")
    assert [str(r.m) for r in rows.select(splits.next_midnight(F.col("t")).alias("m")).collect()] == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def test_weights_are_renormalised_over_the_strata_that_are_there(spark):
    rows = spark.createDataFrame([("r", "regular", 1.0), ("r", "stress", 4.0)], "run string, stratum string, value double")
    assert search.stratified_objective(rows, ["run"]).first().objective == pytest.approx((0.5 * 1 + 0.25 * 4) / 0.75)


def test_selection_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([(m, t, 1.0) for m in ("b", "a") for t in ("P", "Q")], "model_id string, target string, rmse double")
    assert [r.model_id for r in compare.select_system(rows).where("selected = 1").collect()] == ["a"]


def test_equal_forecasts_collapse_whatever_their_order(spark):
    stamps = [f"2024-01-01 {h:02d}:00:00" for h in range(24)]
    rows = [("x", s, 1.0, 2.0) for s in stamps] + [("y", s, 1.0, 2.0) for s in reversed(stamps)] + [("z", s, 1.0, 2.5) for s in stamps]
    facts = spark.createDataFrame(rows, "model_id string, s string, y_true double, y_pred double").withColumn("ts", F.to_timestamp_ntz("s"))
    out = compare.collapse_duplicates(compare.signatures(facts, ["model_id"]), [])
    assert {r.model_id: r.canonical for r in out.collect()} == {"x": "x", "y": "x", "z": "z"}


def test_zero_actuals_leave_percentages_null(spark):
    facts = spark.createDataFrame([("m", 0.0, 0.0)], "model_id string, y_true double, error double")
    got = metrics.summarise(facts, ["model_id"]).first()
    assert got.mape is None and got.wmape is None and got.rmse == 0


def test_names():
    assert math.isclose(sum(search.STRATA.values()), 1)
    assert planner.catalogue.__doc__


#: Queries of the findings on daily tests, and what a pair of equal forecasts has there.
EQUAL_FORECASTS = {
    "Q23_dm_daily_auto_lag": ("status", "identical losses"),
    "Q25_dm_bounds": ("status", "identical losses"),
    "Q35_p_value_matrix": ("dup_naive24", 1.0),
    "Q24_dm_fixed_lag": ("p_value", 1.0),
    "Q25_dm_holm": ("p_holm", 1.0),
}


@pytest.mark.parametrize("name", sorted(EQUAL_FORECASTS))
def test_equal_forecasts_have_identical_losses_in_any_order_of_rows(spark, monkeypatch, name):
    from tidecast.plans import comparison, registry

    rng = random.Random(7)
    hours = [(d, h, rng.uniform(1e6, 1e9)) for d in range(1, 12) for h in range(24)]
    rows = [("dup_naive24", *r) for r in hours] + [("naive24", *r) for r in reversed(hours)]
    frame = spark.createDataFrame(rows, "model_id string, d int, h int, v double").coalesce(1)
    frame = frame.select("model_id", F.lit("P").alias("target"), F.expr("make_date(2024, 1, d)").alias("date"), F.expr("make_timestamp_ntz(2024, 1, d, h, 0, 0)").alias("ts"), *[F.col("v").alias(c) for c in ("se", "ae", "crps", "pb")])
    monkeypatch.setattr(comparison, "hourly_losses", lambda *_: frame)
    column, value = EQUAL_FORECASTS[name]
    got = registry.queries()[name](spark, "").where("model_id = 'naive24'" if name.startswith("Q35") else "model_a = 'dup_naive24'").collect()
    assert len(got) == 4 and {r[column] for r in got} == {value}

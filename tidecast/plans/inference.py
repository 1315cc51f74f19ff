"""Queries of full metric rows, hourly losses with their sources, planned and per-horizon tests, fitted recursions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import dm, features, learners, metrics
from tidecast.plans.base import CALIBRATION, EVALUATION, HOURLY, facts, obs, r, sql, stamp
from tidecast.plans.comparison import _AUTO, _DAILY, _DM, _LOSSES, _P, hourly_losses, pair_tests
from tidecast.plans.evaluation import _IV, NAMES, POINT, POINTS, D, S, day, predictive_rows, rounded
from tidecast.plans.registry import query

COVERAGES = ((0.8, "80"), (0.95, "95"))
_SCALE = ", sc AS (SELECT target, avg(d) AS scale FROM (SELECT target, abs(y - lag(y, 24) OVER (PARTITION BY target ORDER BY ts)) AS d FROM obs WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1)"
_INTERVALS = ", ".join(f"avg(CASE WHEN coverage = {c} THEN {v} END) AS {n}{code}" for c, code in COVERAGES for n, v in (("coverage", "CAST(y_true BETWEEN lower AND upper AS INT)"), ("width", "upper - lower"), ("interval_score", "upper - lower + 2 / (1 - coverage) * (greatest(lower - y_true, 0) + greatest(y_true - upper, 0))")))
_INTERVAL_NAMES = [f"{n}{code}" for _, code in COVERAGES for n in ("coverage", "width", "interval_score")]


def _scale(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(metrics.mase_scale(obs(spark, sf), "2024-01-20 00:00:00"))


def interval_means(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage80, width80, interval_score80, coverage95, ...): the means of each nominal coverage side by side."""
    each = [F.avg(F.when(F.col("coverage") == c, F.col(v))).alias(f"{n}{code}") for c, code in COVERAGES for n, v in (("coverage", "covered"), ("width", "width"), ("interval_score", "score"))]
    return intervals.groupBy(*keys).agg(*each)


@query("A02_metric_row", sql(_LOSSES + _IV + _SCALE + f""", pt AS (SELECT model_id, target, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in POINT.items())} FROM facts GROUP BY 1, 2),
pl AS (SELECT model_id, target, avg(crps) AS crps, avg(pb) AS pinball FROM hl GROUP BY 1, 2), it AS (SELECT model_id, target, {_INTERVALS} FROM iv GROUP BY 1, 2)
SELECT model_id, target, n, {', '.join(f'round({k}, 6) AS {k}' for k in [*NAMES, 'crps', 'pinball', *_INTERVAL_NAMES])}, round(mae / scale, 6) AS mase, round(coverage80 - 0.8, 6) AS gap80, round(coverage95 - 0.95, 6) AS gap95, round((abs(coverage80 - 0.8) + abs(coverage95 - 0.95)) / 2, 6) AS calibration_mae, round((interval_score80 + interval_score95) / 2, 6) AS mean_interval_score
FROM pt JOIN pl USING (model_id, target) JOIN it USING (model_id, target) JOIN sc USING (target)"""))
def metric_row(spark: SparkSession, sf: str) -> DataFrame:
    key = ["model_id", "target"]
    points = metrics.summarise(facts(spark, sf), key).join(_scale(spark, sf), "target")
    losses = hourly_losses(spark, sf).groupBy(*key).agg(F.avg("crps").alias("crps"), F.avg("pb").alias("pinball"))
    got = points.join(losses, key).join(interval_means(predictive_rows(spark, sf)[1], key), key)
    gap80, gap95 = F.col("coverage80") - 0.8, F.col("coverage95") - 0.95
    more = {"mase": F.col("mae") / F.col("scale"), "gap80": gap80, "gap95": gap95, "calibration_mae": (F.abs(gap80) + F.abs(gap95)) / 2, "mean_interval_score": (F.col("interval_score80") + F.col("interval_score95")) / 2}
    return rounded(got.withColumns(more), [*key, "n"], [*NAMES, "crps", "pinball", *_INTERVAL_NAMES, *more])


@query("A05_daily_losses", sql(_LOSSES + _IV + _SCALE + f""", pt AS (SELECT model_id, target, date, {', '.join(f'{v} AS {k}' for k, v in POINT.items())} FROM facts GROUP BY 1, 2, 3),
pl AS (SELECT model_id, target, date, avg(se) AS se, avg(ae) AS ae, avg(crps) AS crps, avg(pb) AS pb FROM hl GROUP BY 1, 2, 3), it AS (SELECT model_id, target, date, {_INTERVALS} FROM iv GROUP BY 1, 2, 3)
SELECT model_id, target, {D}, round(se, 3) AS se, {', '.join(f'round({k}, 6) AS {k}' for k in ['ae', 'crps', 'pb', *NAMES, 'coverage80', 'coverage95'])}, round(mae / scale, 6) AS mase FROM pt JOIN pl USING (model_id, target, date) JOIN it USING (model_id, target, date) JOIN sc USING (target)"""))
def daily_losses(spark: SparkSession, sf: str) -> DataFrame:
    key = ["model_id", "target", "date"]
    points = metrics.summarise(facts(spark, sf), key).join(_scale(spark, sf), "target").withColumn("mase", F.col("mae") / F.col("scale"))
    losses = hourly_losses(spark, sf).groupBy(*key).agg(*[F.avg(c).alias(c) for c in ("se", "ae", "crps", "pb")])
    got = points.join(losses, key).join(interval_means(predictive_rows(spark, sf)[1], key), key)
    return got.select("model_id", "target", day(), r("se", 3).alias("se"), *[r(c).alias(c) for c in ("ae", "crps", "pb", *NAMES, "coverage80", "coverage95", "mase")])


@query("A04_overall_metrics", sql(_LOSSES + f", pl AS (SELECT model_id, target, avg(crps) AS crps, avg(pb) AS pb FROM hl GROUP BY 1, 2), pt AS (SELECT model_id, target, count(*) AS n, count(DISTINCT date) AS n_days, {POINTS} FROM facts GROUP BY 1, 2) SELECT pt.*, round(crps, 6) AS crps, round(pb, 6) AS pb FROM pt JOIN pl USING (model_id, target)"))
def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    key = ["model_id", "target"]
    days = facts(spark, sf).groupBy(*key).agg(F.count_distinct("date").alias("n_days"))
    losses = hourly_losses(spark, sf).groupBy(*key).agg(F.avg("crps").alias("crps"), F.avg("pb").alias("pb"))
    got = metrics.summarise(facts(spark, sf), key).join(days, key).join(losses, key)
    return rounded(got, [*key, "n", "n_days"], [*NAMES, "crps", "pb"])


#: The published variants of the percentage errors, by what they do about small denominators.
_VARIANTS = {
    "mape_floor": "100 * avg(abs(error) / greatest(abs(y_true), 2.220446049250313e-16))",
    "mape_rows": "100 * avg(CASE WHEN abs(y_true) > 1e-8 THEN abs(error) / abs(y_true) END)",
    "mape_plus": "100 * avg(abs(error) / (abs(y_true) + 1e-8))",
    "smape_plus": "100 * avg(2 * abs(error) / (abs(y_true) + abs(y_pred) + 1e-8))",
    "smape_rows": "100 * avg(CASE WHEN abs(y_true) + abs(y_pred) > 1e-8 THEN 2 * abs(error) / (abs(y_true) + abs(y_pred)) END)",
    "smape_floor": "100 * avg(2 * abs(error) / greatest(abs(y_true) + abs(y_pred), 1e-8))",
    "wmape": "100 * sum(abs(error)) / nullif(sum(abs(y_true)), 0)",
    "wmape_plus": "100 * sum(abs(error)) / (sum(abs(y_true)) + 1e-8)",
}


@query("A09_A11_percentage_errors", sql(f" SELECT model_id, target, {', '.join(f'round({v}, 6) AS {k}' for k, v in _VARIANTS.items())} FROM facts WHERE y_true > 0 GROUP BY 1, 2"))
def percentage_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).where("y_true > 0")
    return rounded(metrics.percentage_errors(rows, ["model_id", "target"]), ["model_id", "target"], list(_VARIANTS))


#: Models whose CRPS and pinball losses play stored columns; those of the others are made from quantiles.
_STORED = "('naive24', 'mean24')"


@query("Q17_hourly_losses", sql(_LOSSES + f""", qa AS (SELECT *, (tau - lag(tau) OVER w) * (pinball + lag(pinball) OVER w) / 2 AS a FROM ql WINDOW w AS (PARTITION BY model_id, target, ts ORDER BY tau)), qc AS (SELECT model_id, target, ts, 2 * sum(a) AS made FROM qa GROUP BY 1, 2, 3)
SELECT model_id, target, {S.format('ts')} AS ts, round(se, 3) AS se, round(ae, 6) AS ae, round(pb, 6) AS pb, round(CASE WHEN model_id IN {_STORED} THEN crps ELSE made END, 6) AS crps, CASE WHEN model_id IN {_STORED} THEN 'stored' ELSE 'made from quantiles' END AS crps_source FROM hl JOIN qc USING (model_id, target, ts)"""))
def losses_with_sources(spark: SparkSession, sf: str) -> DataFrame:
    stored = hourly_losses(spark, sf).withColumn("crps", F.when(F.expr(f"model_id in {_STORED}"), F.col("crps")))
    out = metrics.with_made_crps(stored, predictive_rows(spark, sf)[0])
    return out.select("model_id", "target", stamp("ts").alias("ts"), r("se", 3).alias("se"), *[r(c).alias(c) for c in ("ae", "pb", "crps")], "crps_source")


@query("Q36_four_loss_vectors", sql(_LOSSES + f" SELECT model_id, target, {S.format('ts')} AS ts, loss, round(CASE loss WHEN 'squared' THEN se WHEN 'absolute' THEN ae WHEN 'crps' THEN crps ELSE pb END, 3) AS value FROM hl, (VALUES ('squared'), ('absolute'), ('crps'), ('pinball')) v(loss)"))
def four_loss_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly_losses(spark, sf).select("model_id", "target", stamp("ts").alias("ts"), F.expr("stack(4, 'squared', se, 'absolute', ae, 'crps', crps, 'pinball', pb) as (loss, value)"))
    return rows.withColumn("value", r("value", 3))


_BY_HORIZON = _LOSSES + ", ll AS (SELECT model_id, target, date, loss || '|' || horizon AS loss, CASE loss WHEN 'SE' THEN se WHEN 'AE' THEN ae WHEN 'CRPS' THEN crps ELSE pb END AS v FROM hl, (VALUES ('SE'), ('AE'), ('CRPS'), ('PB')) w(loss))"


@query("Q26_horizon_dm", sql(_BY_HORIZON + _DM.format(lag=_AUTO) + _P + """, gk AS (SELECT *, split_part(loss, '|', 1) AS family, row_number() OVER (PARTITION BY target, split_part(loss, '|', 1) ORDER BY p_value) AS gk, count(p_value) OVER (PARTITION BY target, split_part(loss, '|', 1)) AS gm FROM pairs)
SELECT target, family AS loss, CAST(split_part(loss, '|', 2) AS INT) AS horizon, model_a, model_b, n, round(mean_difference, 3) AS mean_difference, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm_within_horizon, round(CASE WHEN p_value IS NOT NULL THEN max(least(1, (gm - gk + 1) * p_value)) OVER (PARTITION BY target, family ORDER BY gk) END, 6) AS p_holm_global, status FROM gk"""))
def horizon_dm(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly_losses(spark, sf).select("model_id", "target", "date", "horizon", F.expr("stack(4, 'SE', se, 'AE', ae, 'CRPS', crps, 'PB', pb) as (loss, v)"))
    differences = dm.pair_differences(rows, ["target", "loss", "horizon", "date"], "v")
    tests = dm.dm_tests(differences, ["target", "loss", "horizon", "model_a", "model_b"], "date")
    ties = ["model_a", "model_b"]
    tests = dm.holm(tests, ["target", "loss", "horizon"], out="p_holm_within_horizon", ties=ties)
    tests = dm.holm(tests, ["target", "loss"], out="p_holm_global", ties=["horizon", *ties])
    return tests.select("target", "loss", "horizon", *ties, "n", r("mean_difference", 3).alias("mean_difference"), *[r(c).alias(c) for c in ("p_value", "p_holm_within_horizon", "p_holm_global")], "status")


#: Planned contrasts, and the first days of the two samples that they are tested on: 23 days and 22 days.
CONTRASTS = [("same hour against the day before", "hourmean7d", "naive24"), ("mean against the day before", "mean24", "naive24"), ("week against the day before", "naive168", "naive24")]
_SAMPLES = {"all": "2024-01-08", "one day less": "2024-01-09"}
_PLANNED = """, lo AS (SELECT model_id, target, date, avg(error * error) AS v FROM allfacts GROUP BY 1, 2, 3),
pr AS (SELECT p.target, s.sample || '|' || c.contrast AS loss, p.date, c.a AS model_a, c.b AS model_b, p.v - q.v AS d FROM (VALUES """ + ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in CONTRASTS) + ") c(contrast, a, b), (VALUES " + ", ".join(f"('{s}', DATE '{d}')" for s, d in _SAMPLES.items()) + """) s(sample, since), lo p, lo q WHERE p.model_id = c.a AND q.model_id = c.b AND p.target = q.target AND p.date = q.date AND p.date >= s.since)"""


@query("Q29_planned_contrasts", sql(_PLANNED + _DM[_DM.index(",\nce AS") :].format(lag=_AUTO) + _P + ", gh AS (SELECT *, split_part(loss, '|', 1) AS sample, row_number() OVER (PARTITION BY target, split_part(loss, '|', 1) ORDER BY p_value) AS gk, count(p_value) OVER (PARTITION BY target, split_part(loss, '|', 1)) AS gm FROM pairs) SELECT target, sample, split_part(loss, '|', 2) AS contrast, n, round(mean_difference, 3) AS mean_difference, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(max(least(1, (gm - gk + 1) * p_value)) OVER (PARTITION BY target, sample ORDER BY gk), 6) AS p_holm FROM gh"))
def planned_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    daily = facts(spark, sf, (CALIBRATION[0], EVALUATION[1])).groupBy("model_id", "target", "date").agg(F.avg(F.col("error") * F.col("error")).alias("v"))
    contrasts = spark.createDataFrame(CONTRASTS, "contrast string, model_a string, model_b string")
    samples = spark.createDataFrame([(s, d) for s, d in _SAMPLES.items()], "sample string, since string")
    differences = dm.planned_differences(daily, contrasts, ["target", "date"], "v")
    differences = differences.join(F.broadcast(samples)).where("date >= cast(since as date)")
    tests = dm.dm_tests(differences, ["target", "sample", "contrast"], "date")
    tests = dm.holm(tests, ["target", "sample"], ties=["contrast"])
    return tests.select("target", "sample", "contrast", "n", r("mean_difference", 3).alias("mean_difference"), r("statistic").alias("statistic"), r("p_value").alias("p_value"), r("p_holm").alias("p_holm"))


@query("Q41_Q42_test_summary", sql(_DAILY + _DM.format(lag=_AUTO) + _P + " SELECT target, loss, count(*) AS pairs, count(*) FILTER (status = 'ok') AS tested, count(*) FILTER (p_value < 0.05) AS significant, count(*) FILTER (p_holm < 0.05) AS after_holm, round(min(p_value), 6) AS least_p FROM pairs GROUP BY 1, 2"))
def test_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = pair_tests(spark, sf).groupBy("target", "loss")
    return found.agg(F.count("*").alias("pairs"), F.count_if(F.col("status") == "ok").alias("tested"), F.count_if(F.col("p_value") < 0.05).alias("significant"), F.count_if(F.col("p_holm") < 0.05).alias("after_holm"), r(F.min("p_value")).alias("least_p"))


_ROLL = "OVER (PARTITION BY target ORDER BY ts RANGE BETWEEN INTERVAL {w} HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"


@query("W03_rolling_observed_then_predicted", sql(" , v AS (SELECT o.target, o.ts, CASE WHEN o.ts < TIMESTAMP '2024-01-20' THEN o.y ELSE s.y END AS v FROM obs o LEFT JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 24 HOUR), w AS (SELECT target, ts, " + ", ".join(f"avg(v) {_ROLL.format(w=w)} AS rmean_{w}, stddev_samp(v) {_ROLL.format(w=w)} AS rstd_{w}, {w} - count(v) {_ROLL.format(w=w)} AS missing_{w}" for w in (24, 168)) + f" FROM v) SELECT target, {S.format('ts')} AS ts, " + ", ".join(f"round(rmean_{w}, 6) AS rmean_{w}, round(rstd_{w}, 6) AS rstd_{w}, missing_{w}" for w in (24, 168)) + " FROM w WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'", HOURLY))
def rolling_observed_then_predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf)
    predicted = features.seasonal_shift(rows, 24).select("target", "ts", "y_pred")
    out = features.rolling_recursive(features.observed_or_predicted(rows, predicted, "2024-01-19 23:00:00"), [24, 168], "2024-01-20 00:00:00", "2024-01-20 23:00:00")
    return out.select("target", stamp("ts").alias("ts"), *[c for w in (24, 168) for c in (r(f"rmean_{w}").alias(f"rmean_{w}"), r(f"rstd_{w}").alias(f"rstd_{w}"), f"missing_{w}")])


_GAPS = (0, 1, 3)
_FITTED = f""", l AS (SELECT target, ts, CAST(ts AS DATE) AS date, y, lag(y, 1) OVER (PARTITION BY target ORDER BY ts) AS x, lag(y, 24) OVER (PARTITION BY target ORDER BY ts) AS z FROM obs),
o AS (SELECT origin, gap FROM generate_series(DATE '2024-01-20', DATE '2024-01-30', INTERVAL 1 DAY) t(origin), (VALUES {', '.join(f'({g})' for g in _GAPS)}) v(gap)),
m AS (SELECT CAST(origin AS DATE) AS origin, gap, target, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, count(*) AS n FROM o JOIN l ON date < CAST(origin AS DATE) - gap AND z IS NOT NULL GROUP BY ALL),
f AS (SELECT *, (xy * vz - zy * xz) / (vx * vz - xz * xz) AS b, (zy * vx - xy * xz) / (vx * vz - xz * xz) AS c FROM m), g AS (SELECT *, my - b * mx - c * mz AS a FROM f)"""


@query("Q39_fitted_pairs", sql(_FITTED + " SELECT strftime(origin, '%Y-%m-%d') AS origin, CAST(gap AS INT) AS gap, target, n, round(a, 3) AS a, round(b, 6) AS b, round(c, 6) AS c FROM g", HOURLY))
def fitted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = learners.two_lag_fits(obs(spark, sf), _origins(spark))
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "gap", "target", "n", r("a", 3).alias("a"), r("b").alias("b"), r("c").alias("c"))


def _origins(spark: SparkSession) -> DataFrame:
    days = spark.sql("select explode(sequence(date '2024-01-20', date '2024-01-30', interval 1 day)) as origin")
    return days.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in _GAPS])))


@query("Q06_Q08_fitted_recursion", sql(_FITTED + """, hist AS (SELECT g.origin, gap, g.target, a, b, c, list(y ORDER BY ts) AS s FROM g JOIN obs ON obs.target = g.target AND ts >= g.origin - INTERVAL 24 HOUR AND ts < g.origin GROUP BY ALL),
rec AS (SELECT origin, gap, target, a, b, c, 0 AS k, s FROM hist UNION ALL SELECT origin, gap, target, a, b, c, k + 1, list_append(s[2:], a + b * s[24] + c * s[1]) FROM rec WHERE k < 24)
SELECT strftime(origin, '%Y-%m-%d') AS origin, CAST(gap AS INT) AS gap, target, CAST(k AS INT) AS horizon, round(s[24], 3) AS y_pred FROM rec WHERE k > 0""", HOURLY).replace("WITH ", "WITH RECURSIVE ", 1))
def fitted_recursion(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf)
    out = learners.two_lag_recursion(rows, learners.two_lag_fits(rows, _origins(spark)), 24)
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "gap", "target", "horizon", r("y_pred", 3).alias("y_pred"))


@query("Q40_gap_evaluation", sql(_FITTED + """, hist AS (SELECT g.origin, gap, g.target, a, b, c, list(y ORDER BY ts) AS s FROM g JOIN obs ON obs.target = g.target AND ts >= g.origin - INTERVAL 24 HOUR AND ts < g.origin GROUP BY ALL),
rec AS (SELECT origin, gap, target, a, b, c, 0 AS k, s FROM hist UNION ALL SELECT origin, gap, target, a, b, c, k + 1, list_append(s[2:], a + b * s[24] + c * s[1]) FROM rec WHERE k < 24),
fc AS (SELECT CAST(gap AS INT) AS gap, 'fitted' AS model_id, target, origin, CAST(origin AS TIMESTAMP) + to_hours(CAST(k - 1 AS INT)) AS ts, s[24] AS y_pred FROM rec WHERE k > 0 UNION ALL SELECT v.gap, 'naive24', o.target, CAST(o.ts AS DATE), o.ts, p.y FROM obs o JOIN obs p ON p.target = o.target AND p.ts = o.ts - INTERVAL 24 HOUR, (VALUES """ + ", ".join(f"({g})" for g in _GAPS) + """) v(gap) WHERE o.ts >= TIMESTAMP '2024-01-20' AND o.ts < TIMESTAMP '2024-01-31')
SELECT fc.gap, model_id, target, count(*) AS n, round(sqrt(avg((o.y - y_pred) * (o.y - y_pred))), 3) AS rmse FROM fc JOIN obs o USING (target, ts) GROUP BY 1, 2, 3""", HOURLY).replace("WITH ", "WITH RECURSIVE ", 1))
def gap_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf)
    fitted = learners.two_lag_recursion(rows, learners.two_lag_fits(rows, _origins(spark)), 24)
    fitted = fitted.select("gap", F.lit("fitted").alias("model_id"), "target", F.expr("cast(origin as timestamp_ntz) + make_dt_interval(0, horizon - 1)").alias("ts"), "y_pred")
    naive = features.seasonal_shift(rows, 24).select(F.explode(F.array(*[F.lit(g) for g in _GAPS])).alias("gap"), F.lit("naive24").alias("model_id"), "target", "ts", "y_pred")
    days = F.broadcast(fitted.select("ts").distinct())
    both = fitted.unionByName(naive.join(days, "ts", "left_semi")).join(rows, ["target", "ts"])
    e = F.col("y") - F.col("y_pred")
    return both.groupBy("gap", "model_id", "target").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


@query("Q07_direct_forecast", sql(" , l AS (SELECT target, ts, hour(ts) + 1 AS horizon, y, lag(y, 24) OVER (PARTITION BY target ORDER BY ts) AS x FROM obs), f AS (SELECT target, horizon, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE ts < TIMESTAMP '2024-01-20' AND x IS NOT NULL GROUP BY 1, 2) SELECT l.target, " + S.format("ts") + " AS ts, CAST(horizon AS INT) AS horizon, round(a + b * x, 3) AS y_pred FROM l JOIN f USING (target, horizon) WHERE ts >= TIMESTAMP '2024-01-20'", HOURLY))
def direct_forecast(spark: SparkSession, sf: str) -> DataFrame:
    out = learners.direct_forecast(obs(spark, sf), "2024-01-20 00:00:00")
    return out.select("target", stamp("ts").alias("ts"), "horizon", r("y_pred", 3).alias("y_pred"))


@query("M20_snapshot_refit", sql(_FITTED + " SELECT strftime(origin, '%Y-%m-%d') AS cutoff, target, n, round(a, 3) AS a, round(b, 6) AS b, round(c, 6) AS c FROM g WHERE gap = 0 AND origin = DATE '2024-01-25'", HOURLY))
def snapshot_refit(spark: SparkSession, sf: str) -> DataFrame:
    cutoff = spark.sql("select date '2024-01-25' as origin, 0 as gap")
    out = learners.two_lag_fits(obs(spark, sf), cutoff)
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("cutoff"), "target", "n", r("a", 3).alias("a"), r("b").alias("b"), r("c").alias("c"))


@query("M05_fold_matrices", sql(" , l AS (SELECT ts, y, lag(y, 1) OVER (ORDER BY ts) AS lag_1, lag(y, 24) OVER (ORDER BY ts) AS lag_24 FROM obs WHERE target = 'P'), f AS (SELECT fold, TIMESTAMP '2024-01-08' + to_days(CAST(4 * fold AS INT)) AS cut FROM range(1, 6) t(fold)) SELECT CAST(fold AS INT) AS fold, CASE WHEN ts < cut THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(y), 6) AS y, round(avg(lag_1), 6) AS lag_1, round(avg(lag_24), 6) AS lag_24 FROM l, f WHERE lag_24 IS NOT NULL AND ts < cut + INTERVAL 4 DAY GROUP BY 1, 2", HOURLY))
def fold_matrices(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.lag_features(obs(spark, sf).where("target = 'P'"), [1, 24]).where("lag_24 is not null")
    folds = spark.range(1, 6).select(F.col("id").cast("int").alias("fold"), F.expr("timestamp_ntz '2024-01-08 00:00:00' + make_dt_interval(cast(4 * id as int))").alias("cut"))
    out = learners.fold_sums(rows, folds, ["y", "lag_1", "lag_24"], 4)
    return out.select("fold", "part", "n", *[r(c).alias(c) for c in ("y", "lag_1", "lag_24")])

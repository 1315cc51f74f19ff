"""Queries of the evaluation stage: forecasts, point metrics, roll-ups, quantiles, intervals, CRPS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.operators import forecast, grid, metrics, probabilistic
from tidecast.plans.base import CALIBRATION, EVALUATION, HOURLY, facts, obs, r, sql, stamp
from tidecast.plans.registry import query

S = "strftime({}, '%Y-%m-%d %H:%M:%S')"
D = "strftime(date, '%Y-%m-%d') AS date"
NAMES = ["rmse", "mae", "mape", "smape", "wmape", "bias"]
POINT = {
    "rmse": "sqrt(avg(error * error))",
    "mae": "avg(abs(error))",
    "mape": "100 * avg(CASE WHEN abs(y_true) > 1e-8 THEN abs(error) / abs(y_true) END)",
    "smape": "100 * avg(CASE WHEN abs(y_true) + abs(y_pred) > 1e-8 THEN 2 * abs(error) / (abs(y_true) + abs(y_pred)) END)",
    "wmape": "100 * sum(abs(error)) / nullif(sum(abs(y_true)), 0)",
    "bias": "avg(error)",
}
POINTS = ", ".join(f"round({v}, 6) AS {k}" for k, v in POINT.items())


def day(column: str = "date") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd").alias("date")


def rounded(df: DataFrame, keys: list, names: list[str]) -> DataFrame:
    return df.select(*keys, *[r(n).alias(n) for n in names])


@query("Q01_seasonal_naive_losses", sql(f" SELECT target, {D}, count(*) AS n, {POINTS} FROM facts WHERE model_id = 'naive24' GROUP BY target, date"))
def seasonal_naive_losses(spark: SparkSession, sf: str) -> DataFrame:
    points = forecast.in_period(forecast.whole_days(forecast.seasonal_naive(obs(spark, sf), 24)), *EVALUATION)
    return rounded(metrics.summarise(points, ["target", "date"]), ["target", day(), "n"], NAMES)


@query("Q02_naive_168", sql(f" SELECT target, {S.format('ts')} AS ts, CAST(horizon AS INT) AS horizon, round(y_pred, 6) AS y_pred, round(error, 6) AS error FROM facts WHERE model_id = 'naive168'"))
def naive_168(spark: SparkSession, sf: str) -> DataFrame:
    points = forecast.in_period(forecast.seasonal_naive(obs(spark, sf), 168), *EVALUATION)
    return rounded(points, ["target", stamp("ts").alias("ts"), "horizon"], ["y_pred", "error"])


@query("Q05_all_points", sql(f" SELECT model_id, target, {S.format('ts')} AS ts, CAST(horizon AS INT) AS horizon, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM facts"))
def all_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(facts(spark, sf), ["model_id", "target", stamp("ts").alias("ts"), "horizon"], ["y_true", "y_pred"])


_WEIGHTS = {"P": (0.5, 0.3, 0.1), "Q": (0.4, 0.5, 0.02)}


@query("Q04_joint_recursion", sql("""
, d AS (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-01-30', INTERVAL 1 DAY)) AS o),
hist AS (SELECT o, list(p ORDER BY ts) AS p, list(q ORDER BY ts) AS q FROM d JOIN hourly ON ts >= o - INTERVAL 24 HOUR AND ts < o GROUP BY o),
rec AS (SELECT o, 0 AS k, p, q FROM hist UNION ALL SELECT o, k + 1, list_append(p[2:], 0.5 * p[24] + 0.3 * p[1] + 0.1 * q[24]), list_append(q[2:], 0.4 * q[24] + 0.5 * q[1] + 0.02 * p[24]) FROM rec WHERE k < 24)
SELECT strftime(o, '%Y-%m-%d') AS origin, 'P' AS target, CAST(k AS INT) AS horizon, round(p[24], 6) AS y_pred FROM rec WHERE k > 0 UNION ALL SELECT strftime(o, '%Y-%m-%d'), 'Q', CAST(k AS INT), round(q[24], 6) FROM rec WHERE k > 0""".replace("\n, d AS", ", d AS"), HOURLY).replace("WITH ", "WITH RECURSIVE ", 1))
def joint_recursion(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.plans.base import hourly

    pair = hourly(spark, sf).withColumn("origin", F.date_add(F.to_date("ts"), 1)).where("origin >= date '2024-01-20' and origin <= date '2024-01-30'")
    lists = pair.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("ts", "p", "q"))).alias("s")).select("origin", F.col("s.p").alias("p"), F.col("s.q").alias("q"))
    out = forecast.joint_recursion(lists, 24, _WEIGHTS)
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "target", "horizon", r("y_pred").alias("y_pred"))


@query("A02_point_metrics", sql(f" SELECT model_id, target, count(*) AS n, {POINTS} FROM facts GROUP BY 1, 2"))
def point_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.summarise(facts(spark, sf), ["model_id", "target"]), ["model_id", "target", "n"], NAMES)


@query("A01_tuner_metrics", sql(""" , d AS (SELECT *, abs(y_true - lag(y_true, 24) OVER (PARTITION BY model_id, target ORDER BY ts)) AS step, avg(y_true) OVER (PARTITION BY model_id, target) AS m FROM facts)
SELECT model_id, target, count(*) AS n, round(1 - sum(error * error) / (sum((y_true - m) * (y_true - m)) + 1e-8), 6) AS r2, round(avg(abs(error)) / avg(step), 6) AS mase, round(100 * avg(abs(error) / greatest(abs(y_true), 2.220446049250313e-16)), 6) AS mape_all, round(100 * avg(2 * abs(error) / (abs(y_true) + abs(y_pred) + 1e-8)), 6) AS smape_eps, round(100 * sum(abs(error)) / (sum(abs(y_true)) + 1e-8), 6) AS wmape_eps FROM d GROUP BY 1, 2"""))
def tuner_metrics(spark: SparkSession, sf: str) -> DataFrame:
    series = W.partitionBy("model_id", "target")
    y, e = F.col("y_true"), F.col("error")
    rows = facts(spark, sf).withColumns({"step": F.abs(y - F.lag(y, 24).over(series.orderBy("ts"))), "m": F.avg(y).over(series)})
    out = rows.groupBy("model_id", "target").agg(
        F.count("*").alias("n"),
        (1 - F.sum(e * e) / (F.sum((y - F.col("m")) * (y - F.col("m"))) + 1e-8)).alias("r2"),
        (F.avg(F.abs(e)) / F.avg("step")).alias("mase"),
        (100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16)))).alias("mape_all"),
        (100 * F.avg(2 * F.abs(e) / (F.abs(y) + F.abs(F.col("y_pred")) + 1e-8))).alias("smape_eps"),
        (100 * F.sum(F.abs(e)) / (F.sum(F.abs(y)) + 1e-8)).alias("wmape_eps"),
    )
    return rounded(out, ["model_id", "target", "n"], ["r2", "mase", "mape_all", "smape_eps", "wmape_eps"])


@query("A03_roll_ups", sql(" SELECT model_id, target, CASE WHEN grouping(date) = 0 THEN 'date' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'overall' END AS level, strftime(date, '%Y-%m-%d') AS date, CAST(horizon AS INT) AS horizon, " + POINTS + " FROM facts GROUP BY GROUPING SETS ((model_id, target), (model_id, target, date), (model_id, target, horizon))"))
def roll_ups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roll_ups(facts(spark, sf), NAMES), ["model_id", "target", "level", day(), "horizon"], NAMES)


@query("A27_horizon_rmse", sql(" SELECT target, CAST(horizon AS INT) AS horizon, round(sqrt(avg(error * error)), 6) AS rmse FROM facts WHERE model_id = 'hourmean7d' GROUP BY 1, 2"))
def horizon_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.summarise(facts(spark, sf).where("model_id = 'hourmean7d'"), ["target", "horizon"], ["rmse"]), ["target", "horizon"], ["rmse"])


@query("P10_regimes", sql(f" , g AS (SELECT *, CASE WHEN date < DATE '2024-01-25' THEN 'before_2024-01-25' ELSE 'from_2024-01-25' END AS regime FROM facts UNION ALL SELECT *, 'overall' FROM facts) SELECT model_id, target, regime, count(*) AS n, {POINTS} FROM g GROUP BY 1, 2, 3"))
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.summarise(metrics.regimes(facts(spark, sf), "2024-01-25"), ["model_id", "target", "regime"]), ["model_id", "target", "regime", "n"], NAMES)


@query("A07_mase_scale", sql(" , d AS (SELECT target, abs(y - lag(y, 24) OVER (PARTITION BY target ORDER BY ts)) AS d FROM obs WHERE ts < TIMESTAMP '2024-01-20') SELECT target, round(avg(d), 6) AS scale FROM d GROUP BY 1", HOURLY))
def mase_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.mase_scale(obs(spark, sf), "2024-01-20 00:00:00"), ["target"], ["scale"])


@query("A08_mase_scale_dropped", sql(" , d AS (SELECT target, abs(y - lag(y, 24) OVER (PARTITION BY target ORDER BY ts)) AS d FROM (SELECT target, ts, y FROM obs WHERE y > 150) WHERE ts < TIMESTAMP '2024-01-20') SELECT target, round(avg(d), 6) AS scale FROM d GROUP BY 1", HOURLY))
def mase_scale_dropped(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumn("y", F.when(F.col("y") > 150, F.col("y")))
    return rounded(metrics.mase_scale(rows, "2024-01-20 00:00:00", drop_missing_first=True), ["target"], ["scale"])


@query("A13_paired_scores", sql(""" , s AS (SELECT target, sqrt(avg(error * error)) AS scale FROM facts WHERE model_id = 'naive24' GROUP BY 1), m AS (SELECT model_id, target, sqrt(avg(error * error)) AS rmse FROM facts GROUP BY 1, 2)
SELECT model_id, round(max(CASE WHEN target = 'P' THEN rmse END), 6) AS p, round(max(CASE WHEN target = 'Q' THEN rmse END), 6) AS q, round(avg(rmse / scale), 6) AS joint FROM m JOIN s USING (target) GROUP BY 1"""))
def paired_scores(spark: SparkSession, sf: str) -> DataFrame:
    by_target = metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse"])
    scales = by_target.where("model_id = 'naive24'").select("target", F.col("rmse").alias("scale"))
    return rounded(metrics.normalised_pair(by_target, ["model_id"], scales), ["model_id"], ["p", "q", "joint"])


@query("A13_paired_daily_loss", sql(f""" , s AS (SELECT target, avg(error * error) AS scale FROM cal WHERE model_id = 'naive24' GROUP BY 1), m AS (SELECT model_id, date, target, avg(error * error) AS mse FROM facts GROUP BY 1, 2, 3) SELECT model_id, {D}, round(avg(mse / scale), 6) AS paired FROM m JOIN s USING (target) GROUP BY model_id, date"""))
def paired_daily_loss(spark: SparkSession, sf: str) -> DataFrame:
    daily = metrics.daily_losses(facts(spark, sf))
    scales = metrics.daily_losses(facts(spark, sf, CALIBRATION).where("model_id = 'naive24'"), ["target"]).select("target", F.col("se").alias("scale"))
    return rounded(metrics.normalised_pair(daily, ["model_id", "date"], scales, "se").withColumnRenamed("joint", "paired"), ["model_id", day()], ["paired"])


@query("Q09_trajectory_cube", sql(f""" , w AS (SELECT model_id, date, horizon, max(CASE WHEN target = 'P' THEN error END) AS e_p, max(CASE WHEN target = 'Q' THEN error END) AS e_q FROM facts WHERE y_true <> 0 GROUP BY 1, 2, 3 HAVING max(CASE WHEN target = 'P' THEN error END) IS NOT NULL AND max(CASE WHEN target = 'Q' THEN error END) IS NOT NULL), k AS (SELECT model_id, date FROM w GROUP BY 1, 2 HAVING count(*) = 24)
SELECT model_id, {D}, CAST(horizon AS INT) AS horizon, round(e_p, 6) AS e_p, round(e_q, 6) AS e_q FROM w SEMI JOIN k USING (model_id, date)"""))
def trajectory_cube(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probabilistic.trajectory_cube(facts(spark, sf).where("y_true <> 0")), ["model_id", day(), "horizon"], ["e_p", "e_q"])


KEYS = ["model_id", "target", "horizon"]
_TAUS = ", ".join(str(t) for t in probabilistic.TAUS)
_EQ = f""" , lists AS (SELECT model_id, target, horizon, quantile_cont(error, [{_TAUS}]) AS qs FROM cal GROUP BY 1, 2, 3), eq AS (SELECT model_id, target, horizon, unnest([{_TAUS}]) AS tau, unnest(qs) AS eq FROM lists)"""
_QL = _EQ + """, ql AS (SELECT f.model_id, f.target, f.ts, f.date, f.horizon, f.y_true, e.tau, f.y_pred + e.eq AS q, greatest(e.tau * (f.y_true - f.y_pred - e.eq), (e.tau - 1) * (f.y_true - f.y_pred - e.eq)) AS pinball FROM facts f JOIN eq e USING (model_id, target, horizon))"""
_IV = """ , so AS (SELECT model_id, target, horizon, error, row_number() OVER (PARTITION BY model_id, target, horizon ORDER BY error) AS k, count(*) OVER (PARTITION BY model_id, target, horizon) AS n FROM cal),
b AS (SELECT model_id, target, horizon, c AS coverage, max(CASE WHEN k = least(n, greatest(1, CAST(floor(round((n + 1) * (1 - c) / 2, 9)) AS INT))) THEN error END) AS lo, max(CASE WHEN k = greatest(1, least(n, CAST(ceil(round((n + 1) * (1 - (1 - c) / 2), 9)) AS INT))) THEN error END) AS hi FROM so, (VALUES (0.8::DOUBLE), (0.95::DOUBLE)) v(c) GROUP BY ALL),
iv AS (SELECT f.model_id, f.target, f.ts, f.date, f.horizon, f.y_true, b.coverage, y_pred + lo AS lower, y_pred + hi AS upper FROM facts f JOIN b USING (model_id, target, horizon))"""


def predictive_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return probabilistic.predictive(facts(spark, sf), facts(spark, sf, CALIBRATION), probabilistic.TAUS, [0.8, 0.95])


@query("Q10_error_quantiles", sql(_EQ + " SELECT model_id, target, CAST(horizon AS INT) AS horizon, CAST(tau AS DOUBLE) AS tau, round(eq, 6) AS q FROM eq"))
def error_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probabilistic.ensemble_quantiles(facts(spark, sf, CALIBRATION), KEYS, probabilistic.TAUS), [*KEYS, "tau"], ["q"])


@query("Q11_conformal_bounds", sql(_IV + " SELECT model_id, target, CAST(horizon AS INT) AS horizon, coverage, round(lo, 6) AS lower, round(hi, 6) AS upper FROM b"))
def conformal_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probabilistic.conformal_bounds(facts(spark, sf, CALIBRATION), KEYS, [0.8, 0.95]), [*KEYS, "coverage"], ["lower", "upper"])


@query("Q14_quantile_forecasts", sql(_QL + f" SELECT model_id, target, {S.format('ts')} AS ts, CAST(tau AS DOUBLE) AS tau, round(q, 6) AS q, round(pinball, 6) AS pinball FROM ql"))
def quantile_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictive_rows(spark, sf)[0], ["model_id", "target", stamp("ts").alias("ts"), "tau"], ["q", "pinball"])


@query("Q14_intervals", sql(_IV + f" SELECT model_id, target, {S.format('ts')} AS ts, coverage, CAST(y_true BETWEEN lower AND upper AS INT) AS covered, round(upper - lower, 6) AS width, round(upper - lower + 2 / (1 - coverage) * (greatest(lower - y_true, 0) + greatest(y_true - upper, 0)), 6) AS score FROM iv"))
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictive_rows(spark, sf)[1], ["model_id", "target", stamp("ts").alias("ts"), "coverage", "covered"], ["width", "score"])


@query("A06_interval_summary", sql(_IV + " SELECT model_id, target, coverage, count(*) AS n, round(avg(CASE WHEN y_true BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS empirical, round(avg(CASE WHEN y_true BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) - coverage, 6) AS gap, round(avg(upper - lower), 6) AS width FROM iv GROUP BY 1, 2, 3"))
def interval_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = predictive_rows(spark, sf)[1].groupBy("model_id", "target", "coverage").agg(F.count("*").alias("n"), F.avg("covered").alias("empirical"), F.avg("width").alias("width"))
    return rounded(got.withColumn("gap", F.col("empirical") - F.col("coverage")), ["model_id", "target", "coverage", "n"], ["empirical", "gap", "width"])


@query("Q15_mean_pinball", sql(_QL + " SELECT model_id, target, round(avg(pinball), 6) AS pinball FROM ql GROUP BY 1, 2"))
def mean_pinball(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictive_rows(spark, sf)[0].groupBy("model_id", "target").agg(F.avg("pinball").alias("pinball")), ["model_id", "target"], ["pinball"])


@query("Q13_pinball_by_level", sql(_QL + " SELECT target, CAST(tau AS DOUBLE) AS tau, round(avg(pinball), 6) AS pinball FROM ql WHERE model_id = 'hourmean7d' GROUP BY 1, 2"))
def pinball_by_level(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictive_rows(spark, sf)[0].where("model_id = 'hourmean7d'")
    return rounded(rows.groupBy("target", "tau").agg(F.avg("pinball").alias("pinball")), ["target", "tau"], ["pinball"])


@query("Q16_crps_from_quantiles", sql(_QL + f", z AS (SELECT *, (tau - lag(tau) OVER w) * (pinball + lag(pinball) OVER w) / 2 AS a FROM ql WINDOW w AS (PARTITION BY model_id, target, ts ORDER BY tau)) SELECT model_id, target, {S.format('ts')} AS ts, round(2 * sum(a), 6) AS crps FROM z GROUP BY model_id, target, ts"))
def crps_from_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = probabilistic.crps_from_quantiles(predictive_rows(spark, sf)[0], ["model_id", "target", "ts"])
    return rounded(out, ["model_id", "target", stamp("ts").alias("ts")], ["crps"])


@query("F13_quantile_crossings", sql(_QL + " , z AS (SELECT model_id, target, ts, max(CASE WHEN d < -1e-10 THEN 1 ELSE 0 END) AS bad FROM (SELECT *, q - lag(q) OVER (PARTITION BY model_id, target, ts ORDER BY tau) AS d FROM ql) GROUP BY 1, 2, 3) SELECT model_id, target, CAST(sum(bad) AS BIGINT) AS crossings FROM z GROUP BY 1, 2"))
def quantile_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return probabilistic.quantile_crossings(predictive_rows(spark, sf)[0], ["model_id", "target", "ts"])


@query("F14_interval_inversions", sql(_IV + " SELECT model_id, target, coverage, CAST(sum(CASE WHEN lower > upper THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM iv GROUP BY 1, 2, 3"))
def interval_inversions(spark: SparkSession, sf: str) -> DataFrame:
    return predictive_rows(spark, sf)[1].groupBy("model_id", "target", "coverage").agg(F.sum((F.col("lower") > F.col("upper")).cast("long")).alias("inversions"))


_CRPS = """ , me AS (SELECT f.model_id, f.target, f.ts, f.date, f.y_true, f.y_pred + c.error AS x, row_number() OVER (PARTITION BY f.model_id, f.target, f.ts ORDER BY f.y_pred + c.error) AS k, count(*) OVER (PARTITION BY f.model_id, f.target, f.ts) AS n FROM facts f JOIN cal c USING (model_id, target, horizon)),
cr AS (SELECT model_id, target, ts, date, avg(abs(x - y_true)) - sum((2 * k - n - 1) * x) / (max(n) * max(n)) AS crps FROM me GROUP BY 1, 2, 3, 4)"""


def crps_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = probabilistic.hourly_losses(facts(spark, sf), facts(spark, sf, CALIBRATION), probabilistic.TAUS)
    return out.select("model_id", "target", "ts", "date", "crps")


@query("Q12_crps_ensemble", sql(_CRPS + f" SELECT model_id, target, {S.format('ts')} AS ts, round(crps, 6) AS crps FROM cr"))
def crps_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crps_rows(spark, sf), ["model_id", "target", stamp("ts").alias("ts")], ["crps"])


@query("A17_mean_crps", sql(_CRPS + " , s AS (SELECT target, avg(crps) AS scale FROM cr WHERE model_id = 'naive24' GROUP BY 1), m AS (SELECT model_id, target, avg(crps) AS crps FROM cr GROUP BY 1, 2) SELECT model_id, round(max(CASE WHEN target = 'P' THEN crps END), 6) AS p, round(max(CASE WHEN target = 'Q' THEN crps END), 6) AS q, round(avg(crps / scale), 6) AS joint FROM m JOIN s USING (target) GROUP BY 1"))
def mean_crps(spark: SparkSession, sf: str) -> DataFrame:
    means = crps_rows(spark, sf).groupBy("model_id", "target").agg(F.avg("crps").alias("crps"))
    scales = means.where("model_id = 'naive24'").select("target", F.col("crps").alias("scale"))
    return rounded(metrics.normalised_pair(means, ["model_id"], scales, "crps"), ["model_id"], ["p", "q", "joint"])


@query("Q14_adaptive_pool", sql(" , dd AS (SELECT DISTINCT model_id, target, date FROM facts) SELECT d.model_id, d.target, strftime(d.date, '%Y-%m-%d') AS date, CAST(a.horizon AS INT) AS horizon, count(*) AS n, round(median(a.error), 6) AS middle FROM dd d JOIN allfacts a ON a.model_id = d.model_id AND a.target = d.target AND a.date < d.date GROUP BY d.model_id, d.target, d.date, a.horizon"))
def adaptive_pool(spark: SparkSession, sf: str) -> DataFrame:
    errors = facts(spark, sf, (CALIBRATION[0], EVALUATION[1]))
    pool = probabilistic.adaptive_pool(facts(spark, sf), errors)
    return pool.groupBy("model_id", "target", "date", "horizon").agg(F.count("*").alias("n"), F.percentile("error", 0.5).alias("middle")).select("model_id", "target", day(), "horizon", "n", r("middle").alias("middle"))


@query("Q14_weekend_pool", sql(" SELECT model_id, target, CAST(horizon AS INT) AS horizon, isodow(date) >= 6 AS weekend, count(*) AS n, round(quantile_cont(error, 0.9), 6) AS q90 FROM cal GROUP BY 1, 2, 3, 4"))
def weekend_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = facts(spark, sf, CALIBRATION).withColumn("weekend", F.weekday("date") >= 5)
    return rounded(pool.groupBy(*KEYS, "weekend").agg(F.count("*").alias("n"), F.percentile("error", 0.9).alias("q90")), [*KEYS, "weekend", "n"], ["q90"])


@query("Q19_quantile_intervals", sql(" SELECT model_id, target, CAST(horizon AS INT) AS horizon, round(quantile_cont(error, 0.1), 6) AS lower, round(quantile_cont(error, 0.9), 6) AS upper FROM cal GROUP BY 1, 2, 3"))
def quantile_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, CALIBRATION).groupBy(*KEYS).agg(F.percentile("error", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return rows.select(*KEYS, r(F.col("q")[0]).alias("lower"), r(F.col("q")[1]).alias("upper"))


@query("W06_horizon_numbers", sql(f" SELECT model_id, target, {S.format('ts')} AS ts, CAST(row_number() OVER (PARTITION BY model_id, target, date ORDER BY ts) AS INT) AS horizon FROM facts"))
def horizon_numbers(spark: SparkSession, sf: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("model_id", "target", "date").orderBy("ts"))
    return facts(spark, sf).select("model_id", "target", stamp("ts").alias("ts"), number.alias("horizon"))


@query("F15_common_stamps", sql(f" SELECT target, {S.format('ts')} AS ts FROM facts GROUP BY target, ts HAVING count(DISTINCT model_id) = 5"))
def common_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return grid.common_stamps(facts(spark, sf)).select("target", stamp("ts").alias("ts"))


@query("A32_audit_rows", sql(" , d AS (SELECT model_id, target, date, count(*) AS h FROM facts WHERE y_true > 60 GROUP BY 1, 2, 3) SELECT model_id, target, CAST(sum(h) AS BIGINT) AS n_rows, count(*) AS n_days, count(*) FILTER (h = 24) AS complete_days, CAST(min(h) AS BIGINT) AS min_hours, CAST(max(h) AS BIGINT) AS max_hours FROM d GROUP BY 1, 2"))
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    days = facts(spark, sf).where("y_true > 60").groupBy("model_id", "target", "date").agg(F.count("*").alias("h"))
    return days.groupBy("model_id", "target").agg(F.sum("h").alias("n_rows"), F.count("*").alias("n_days"), F.count_if(F.col("h") == 24).alias("complete_days"), F.min("h").alias("min_hours"), F.max("h").alias("max_hours"))

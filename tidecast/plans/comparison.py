"""Queries of the comparison stage: Diebold-Mariano tests, leagues, ranks, selection, duplicates, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import compare, dm, metrics, probabilistic
from tidecast.plans.base import CALIBRATION, facts, hourly, r, sql, stamp
from tidecast.plans.evaluation import _CRPS, _QL, POINT, crps_rows, rounded
from tidecast.plans.registry import query
from tidecast.sources import tables

#: The four losses of each hour, and of each day.
_LOSSES = _CRPS + _QL + """, pb AS (SELECT model_id, target, ts, avg(pinball) AS pb FROM ql GROUP BY 1, 2, 3),
hl AS (SELECT f.model_id, f.target, f.date, f.horizon, f.ts, f.error * f.error AS se, abs(f.error) AS ae, crps, pb FROM facts f JOIN cr USING (model_id, target, ts) JOIN pb USING (model_id, target, ts))"""
_DAILY = _LOSSES + """, dl AS (SELECT model_id, target, date, round(avg(se), 8) AS se, round(avg(ae), 8) AS ae, round(avg(crps), 8) AS crps, round(avg(pb), 8) AS pb FROM hl GROUP BY 1, 2, 3),
ll AS (SELECT model_id, target, date, 'SE' AS loss, se AS v FROM dl UNION ALL SELECT model_id, target, date, 'AE', ae FROM dl UNION ALL SELECT model_id, target, date, 'CRPS', crps FROM dl UNION ALL SELECT model_id, target, date, 'PB', pb FROM dl)"""
#: Series, autocovariances up to the lag, statistic and status; {lag} is the lag.
_DM = """, pr AS (SELECT a.target, a.loss, a.date, a.model_id AS model_a, b.model_id AS model_b, a.v - b.v AS d FROM ll a JOIN ll b ON a.target = b.target AND a.loss = b.loss AND a.date = b.date AND a.model_id < b.model_id),
ce AS (SELECT *, d - avg(d) OVER w AS c, row_number() OVER (PARTITION BY target, loss, model_a, model_b ORDER BY date) AS i FROM pr WINDOW w AS (PARTITION BY target, loss, model_a, model_b)),
st AS (SELECT target, loss, model_a, model_b, count(*) AS n, avg(d) AS mean_difference, max(abs(d)) AS spread, avg(c * c) AS g0, greatest(0, least({lag}, count(*) - 2)) AS hac_lag FROM ce GROUP BY 1, 2, 3, 4),
ac AS (SELECT x.target, x.loss, x.model_a, x.model_b, y.i - x.i AS l, sum(x.c * y.c) AS s FROM ce x JOIN ce y ON x.target = y.target AND x.loss = y.loss AND x.model_a = y.model_a AND x.model_b = y.model_b AND y.i > x.i AND y.i - x.i <= 10 GROUP BY ALL),
va AS (SELECT st.*, (g0 + coalesce((SELECT sum(2 * (1 - l / (hac_lag + 1.0)) * s / n) FROM ac WHERE ac.target = st.target AND ac.loss = st.loss AND ac.model_a = st.model_a AND ac.model_b = st.model_b AND l <= hac_lag), 0)) / n AS variance FROM st),
dmt AS (SELECT *, CASE WHEN n < 5 THEN 'insufficient sample' WHEN spread <= 1e-12 THEN 'identical losses' WHEN variance <= 1e-15 THEN 'invalid HAC variance' ELSE 'ok' END AS status FROM va),
dms AS (SELECT *, CASE WHEN status = 'ok' THEN sqrt(variance) / sqrt((n - 1.0) / n) END AS se FROM dmt),
dmz AS (SELECT *, mean_difference / se AS statistic, atan(abs(mean_difference / se) / sqrt(n - 1.0)) AS theta FROM dms)"""


def beyond(theta: str, n: str) -> str:
    """SQL for P(|T| > sqrt(n - 1) tan theta) with n - 1 degrees of freedom: the finite series, by gamma functions."""
    even = f"sin({theta}) * list_sum(list_transform(range(0, CAST(({n} - 1) // 2 AS BIGINT)), lambda k: gamma(k + 0.5) / (gamma(k + 1) * sqrt(pi())) * pow(cos({theta}), 2 * k)))"
    odd = f"2 / pi() * ({theta} + sin({theta}) * cos({theta}) * coalesce(list_sum(list_transform(range(0, CAST(({n} - 2) // 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * gamma(k + 1) / gamma(k + 1.5) * pow(cos({theta}), 2 * k))), 0))"
    return f"greatest(0, 1 - CASE WHEN ({n} - 1) % 2 = 0 THEN {even} ELSE {odd} END)"


_P = f""", dmp AS (SELECT *, CASE WHEN status = 'identical losses' THEN 1.0 WHEN status = 'ok' THEN {beyond('theta', 'n')} END AS p_value FROM dmz),
hk AS (SELECT *, row_number() OVER (PARTITION BY target, loss ORDER BY p_value, model_a, model_b) AS k, count(p_value) OVER (PARTITION BY target, loss) AS m FROM dmp),
ho AS (SELECT *, max(least(1, (m - k + 1) * p_value)) OVER (PARTITION BY target, loss ORDER BY k) AS p_holm FROM hk),
pairs AS (SELECT *, CASE WHEN p_holm < 0.05 THEN CASE WHEN mean_difference < 0 THEN model_a WHEN mean_difference > 0 THEN model_b END END AS better_model FROM ho)"""
#: Critical values by halving, one for each sample size; a query that uses it begins WITH RECURSIVE.
_BOUNDS = f""", tq AS (SELECT DISTINCT n, 0.0::DOUBLE AS low, pi() / 2 AS high, 0 AS i FROM dmp WHERE status = 'ok' UNION ALL SELECT n, CASE WHEN p > 0.05 THEN middle ELSE low END, CASE WHEN p > 0.05 THEN high ELSE middle END, i + 1 FROM (SELECT *, {beyond('middle', 'n')} AS p FROM (SELECT *, (low + high) / 2 AS middle FROM tq WHERE i < 55))),
tc AS (SELECT n, sqrt(n - 1.0) * tan(low) AS t FROM tq WHERE i = 55), dmb AS (SELECT pairs.*, mean_difference - t * se AS ci_low, mean_difference + t * se AS ci_high FROM pairs LEFT JOIN tc USING (n))"""
_AUTO = "CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS INT)"


def hourly_losses(spark: SparkSession, sf: str) -> DataFrame:
    """(model_id, target, date, horizon, ts, se, ae, crps, pb): the four losses of each forecast hour."""
    out = probabilistic.hourly_losses(facts(spark, sf), facts(spark, sf, CALIBRATION), probabilistic.TAUS)
    return out.select("model_id", "target", "date", "horizon", "ts", "se", "ae", "crps", "pb")


def daily_long(spark: SparkSession, sf: str) -> DataFrame:
    """(model_id, target, date, loss, v); summed in the order of hours, so that equal forecasts have equal losses however large they are."""
    daily = metrics.ordered_means(hourly_losses(spark, sf), ["model_id", "target", "date"], "ts", ["se", "ae", "crps", "pb"], 8)
    return daily.select("model_id", "target", "date", F.expr("stack(4, 'SE', se, 'AE', ae, 'CRPS', crps, 'PB', pb) as (loss, v)"))


def pair_tests(spark: SparkSession, sf: str, lag: int | None = None) -> DataFrame:
    differences = dm.pair_differences(daily_long(spark, sf), ["target", "loss", "date"], "v")
    tests = dm.dm_tests(differences, ["target", "loss", "model_a", "model_b"], "date", lag)
    return dm.better_model(dm.holm(tests, ["target", "loss"], ties=["model_a", "model_b"]))


@query("J06_daily_pairs", sql(_DAILY + _DM.format(lag=3) + " SELECT target, loss, strftime(date, '%Y-%m-%d') AS date, model_a, model_b, round(d, 3) AS d FROM pr"))
def daily_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.pair_differences(daily_long(spark, sf), ["target", "loss", "date"], "v")
    return out.select("target", "loss", F.date_format("date", "yyyy-MM-dd").alias("date"), "model_a", "model_b", r("d", 3).alias("d"))


@query("J07_horizon_pairs", sql(" , h AS (SELECT model_id, target, date, horizon, error * error AS v FROM facts) SELECT a.target, CAST(a.horizon AS INT) AS horizon, a.model_id AS model_a, b.model_id AS model_b, count(*) AS n, round(avg(a.v - b.v), 3) AS d FROM h a JOIN h b ON a.target = b.target AND a.date = b.date AND a.horizon = b.horizon AND a.model_id < b.model_id GROUP BY 1, 2, 3, 4"))
def horizon_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("v", F.col("error") * F.col("error"))
    out = dm.pair_differences(rows, ["target", "date", "horizon"], "v").groupBy("target", "horizon", "model_a", "model_b")
    return out.agg(F.count("*").alias("n"), r(F.avg("d"), 3).alias("d"))


@query("Q23_dm_daily_auto_lag", sql(_DAILY + _DM.format(lag=_AUTO) + " SELECT target, loss, model_a, model_b, n, CAST(hac_lag AS INT) AS hac_lag, round(mean_difference, 3) AS mean_difference, round(statistic, 6) AS statistic, status FROM dmz"))
def dm_daily_auto_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = pair_tests(spark, sf)
    return out.select("target", "loss", "model_a", "model_b", "n", "hac_lag", r("mean_difference", 3).alias("mean_difference"), r("statistic").alias("statistic"), "status")


@query("Q24_dm_fixed_lag", sql(_DAILY + _DM.format(lag=3) + _P + " SELECT target, loss, model_a, model_b, round(statistic, 6) AS statistic, round(se, 3) AS standard_error, round(p_value, 6) AS p_value, status FROM dmp"))
def dm_fixed_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = pair_tests(spark, sf, 3)
    return out.select("target", "loss", "model_a", "model_b", r("statistic").alias("statistic"), r("standard_error", 3).alias("standard_error"), r("p_value").alias("p_value"), "status")


@query("Q25_dm_holm", sql(_DAILY + _DM.format(lag=_AUTO) + _P + " SELECT target, loss, model_a, model_b, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, better_model FROM pairs"))
def dm_holm(spark: SparkSession, sf: str) -> DataFrame:
    return pair_tests(spark, sf).select("target", "loss", "model_a", "model_b", r("p_value").alias("p_value"), r("p_holm").alias("p_holm"), "better_model")


@query("A28_league", sql(_DAILY + _DM.format(lag=_AUTO) + _P + " , e AS (SELECT target, loss, model_a AS model_id, better_model FROM pairs UNION ALL SELECT target, loss, model_b, better_model FROM pairs) SELECT target, loss, model_id, count(*) FILTER (better_model = model_id) AS wins, count(*) FILTER (better_model <> model_id) AS losses, count(*) FILTER (better_model IS NULL) AS undecided, count(*) FILTER (better_model = model_id) - count(*) FILTER (better_model <> model_id) AS net FROM e GROUP BY 1, 2, 3"))
def league(spark: SparkSession, sf: str) -> DataFrame:
    return dm.league(pair_tests(spark, sf), ["target", "loss"])


@query("Q27_dm_matrix", sql(_DAILY + _DM.format(lag=_AUTO) + _P + " SELECT target, loss, model_a AS \"row\", model_b AS col, round(mean_difference, 3) AS value FROM pairs UNION ALL SELECT target, loss, model_b, model_a, round(-mean_difference, 3) FROM pairs UNION ALL SELECT DISTINCT target, loss, m, m, round(0.0, 3) FROM (SELECT target, loss, unnest([model_a, model_b]) AS m FROM pairs)"))
def dm_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = dm.matrix_cells(pair_tests(spark, sf), ["target", "loss"], "mean_difference", True, 0.0)
    return cells.select("target", "loss", "row", "col", r("value", 3).alias("value"))


_SELECTED = "CASE WHEN model_a = 'hourmean7d' THEN {a} ELSE {b} END"


@query("Q25_dm_bounds", sql(_DAILY + _DM.format(lag=_AUTO) + _P + _BOUNDS + " SELECT target, loss, model_a, model_b, n, status, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high FROM dmb").replace("WITH ", "WITH RECURSIVE ", 1))
def dm_bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.with_bounds(pair_tests(spark, sf))
    return out.select("target", "loss", "model_a", "model_b", "n", "status", r("ci_low", 3).alias("ci_low"), r("ci_high", 3).alias("ci_high"))


@query("Q28_selected_contrasts", sql(_DAILY + _DM.format(lag=_AUTO) + _P + _BOUNDS + " SELECT target, loss, " + _SELECTED.format(a="model_b", b="model_a") + " AS comparator, " + ", ".join(f"round({_SELECTED.format(a=a, b=b)}, {places}) AS {name}" for a, b, name, places in (("mean_difference", "-mean_difference", "difference", 3), ("statistic", "-statistic", "statistic", 6), ("ci_low", "-ci_high", "ci_low", 3), ("ci_high", "-ci_low", "ci_high", 3))) + " FROM dmb WHERE 'hourmean7d' IN (model_a, model_b)").replace("WITH ", "WITH RECURSIVE ", 1))
def selected_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    out = dm.oriented(dm.with_bounds(pair_tests(spark, sf)), "hourmean7d")
    return out.select("target", "loss", "comparator", r("mean_difference", 3).alias("difference"), r("statistic").alias("statistic"), r("ci_low", 3).alias("ci_low"), r("ci_high", 3).alias("ci_high"))


@query("W12_autocovariances", sql(""" , x AS (SELECT target, ts, y - avg(y) OVER (PARTITION BY target) AS c, row_number() OVER (PARTITION BY target ORDER BY ts) AS i, count(*) OVER (PARTITION BY target) AS n FROM obs)
SELECT a.target, CAST(b.i - a.i AS INT) AS lag, round(sum(a.c * b.c) / max(a.n), 6) AS gamma FROM x a JOIN x b ON a.target = b.target AND b.i BETWEEN a.i AND a.i + 3 GROUP BY 1, 2""", start=__import__("tidecast.plans.base", fromlist=["HOURLY"]).HOURLY))
def autocovariances(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    series = W.partitionBy("target")
    rows = tables.observations(hourly(spark, sf)).withColumns({"c": F.col("y") - F.avg("y").over(series), "n": F.count("*").over(series)})
    rows = rows.withColumn("shifted", F.array(*[F.lag("c", k).over(series.orderBy("ts")) for k in range(4)]))
    each = rows.select("target", "c", "n", F.posexplode("shifted").alias("lag", "s")).where("s is not null")
    return each.groupBy("target", "lag").agg(r(F.sum(F.col("c") * F.col("s")) / F.max("n")).alias("gamma"))


_RANKED = " , m AS (SELECT model_id, target, " + ", ".join(f"{POINT[k]} AS {k}" for k in ("rmse", "mae", "wmape")) + " FROM facts GROUP BY 1, 2)"


def by_target(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse", "mae", "wmape"])


@query("W07_min_ranks", sql(_RANKED + " SELECT model_id, target, " + ", ".join(f"CAST(rank() OVER (PARTITION BY target ORDER BY round({k}, 9)) AS INT) AS rank_{k}" for k in ("rmse", "mae", "wmape")) + " FROM m"))
def min_ranks(spark: SparkSession, sf: str) -> DataFrame:
    names = ["rmse", "mae", "wmape"]
    rows = by_target(spark, sf).withColumns({n: F.round(n, 9) for n in names})
    return compare.min_ranks(rows, names).select("model_id", "target", *[f"rank_{n}" for n in names])


@query("W08_pareto", sql(_RANKED + " , z AS (SELECT model_id, target, round(rmse, 9) AS a, round(mae, 9) AS b, round(wmape, 9) AS c FROM m) SELECT model_id, target, CASE WHEN EXISTS (SELECT 1 FROM z o WHERE o.target = z.target AND o.a <= z.a AND o.b <= z.b AND o.c <= z.c AND (o.a < z.a OR o.b < z.b OR o.c < z.c)) THEN 0 ELSE 1 END AS pareto FROM z"))
def pareto(spark: SparkSession, sf: str) -> DataFrame:
    names = ["rmse", "mae", "wmape"]
    rows = by_target(spark, sf).withColumns({n: F.round(n, 9) for n in names})
    return compare.pareto(rows, names).select("model_id", "target", "pareto")


@query("A26_system_selection", sql(_RANKED + " , w AS (SELECT model_id, max(CASE WHEN target = 'P' THEN rmse END) AS p, max(CASE WHEN target = 'Q' THEN rmse END) AS q FROM m GROUP BY 1), s AS (SELECT *, (p / min(p) OVER () + q / min(q) OVER ()) / 2 AS score FROM w) SELECT model_id, round(p, 6) AS p, round(q, 6) AS q, round(score, 6) AS score, CASE WHEN row_number() OVER (ORDER BY round(score, 12), round(p, 9), round(q, 9), model_id) = 1 THEN 1 ELSE 0 END AS selected FROM s"))
def system_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = by_target(spark, sf).withColumn("rmse", F.round("rmse", 9))
    return rounded(compare.select_system(rows), ["model_id", "selected"], ["p", "q", "score"])


@query("L06_best_of_each_target", sql(_RANKED + " SELECT target, min_by(model_id, (round(rmse, 9), model_id)) AS best, round(min(rmse), 6) AS rmse FROM m GROUP BY 1"))
def best_of_each_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = by_target(spark, sf)
    return rows.groupBy("target").agg(F.min_by("model_id", F.struct(F.round("rmse", 9).alias("a"), "model_id")).alias("best"), r(F.min("rmse")).alias("rmse"))


@query("A33_effects", sql(_RANKED + " SELECT a.target, a.model_id AS a, b.model_id AS b, round(200 * (a.rmse - b.rmse) / (a.rmse + b.rmse), 6) AS effect FROM m a JOIN m b ON a.target = b.target AND a.model_id <> b.model_id"))
def effects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.effects(by_target(spark, sf)), ["target", "a", "b"], ["effect"])


_SIGN = " , sg AS (SELECT model_id, target, sha256(string_agg(x, ';' ORDER BY x)) AS signature FROM (SELECT model_id, target, strftime(ts, '%Y-%m-%d %H:%M') || '|' || CAST(CAST(round(y_true, 6) AS DECIMAL(20,6)) AS VARCHAR) || '|' || CAST(CAST(round(y_pred, 6) AS DECIMAL(20,6)) AS VARCHAR) AS x FROM facts) GROUP BY 1, 2)"


def signed(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumns({"y_true": r("y_true"), "y_pred": r("y_pred")})
    return compare.signatures(rows, ["model_id", "target"])


@query("P23_signatures", sql(_SIGN + " SELECT model_id, target, signature FROM sg"))
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return signed(spark, sf)


@query("U08_collapse_duplicates", sql(_SIGN + " SELECT model_id, target, first_value(model_id) OVER (PARTITION BY target, signature ORDER BY model_id) AS canonical FROM sg"))
def collapse_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return compare.collapse_duplicates(signed(spark, sf), ["target"]).select("model_id", "target", "canonical")


@query("W15_canonical_by_priority", sql(_SIGN + " , pr AS (SELECT *, CASE WHEN model_id = 'naive24' THEN 0 ELSE 1 END AS priority FROM sg) SELECT model_id, target, first_value(model_id) OVER (PARTITION BY target, signature ORDER BY priority, model_id) AS canonical FROM pr"))
def canonical_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = signed(spark, sf).withColumn("priority", F.when(F.col("model_id") == "naive24", 0).otherwise(1))
    return compare.collapse_duplicates(rows, ["target"], "priority").select("model_id", "target", "canonical")


@query("U07_pairwise_duplicates", sql(_SIGN + " , w AS (SELECT model_id, string_agg(signature, ',' ORDER BY target) AS both_targets FROM sg GROUP BY 1) SELECT model_id, min(model_id) OVER (PARTITION BY both_targets) AS canonical FROM w"))
def pairwise_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    lists = signed(spark, sf).groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "signature"))), lambda x: x["signature"]).alias("s"))
    return lists.select("model_id", F.min("model_id").over(W.partitionBy("s")).alias("canonical"))


@query("J12_retained_systems", sql(_SIGN + " , keep AS (SELECT DISTINCT first_value(model_id) OVER (PARTITION BY target, signature ORDER BY model_id) AS model_id FROM sg) SELECT f.model_id, count(*) AS n FROM facts f SEMI JOIN keep USING (model_id) GROUP BY 1"))
def retained_systems(spark: SparkSession, sf: str) -> DataFrame:
    keep = compare.collapse_duplicates(signed(spark, sf), ["target"]).select(F.col("canonical").alias("model_id")).distinct()
    return facts(spark, sf).join(keep, "model_id", "left_semi").groupBy("model_id").agg(F.count("*").alias("n"))


@query("A18_daily_crps", sql(_CRPS + " SELECT model_id, target, strftime(date, '%Y-%m-%d') AS date, round(avg(crps), 6) AS crps FROM cr GROUP BY model_id, target, date"))
def daily_crps(spark: SparkSession, sf: str) -> DataFrame:
    out = crps_rows(spark, sf).groupBy("model_id", "target", "date").agg(F.avg("crps").alias("crps"))
    return out.select("model_id", "target", F.date_format("date", "yyyy-MM-dd").alias("date"), r("crps").alias("crps"))


@query("P21_forecast_wide", sql(" SELECT target, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(max(y_true), 6) AS actual, " + ", ".join(f"round(max(CASE WHEN model_id = '{m}' THEN y_pred END), 6) AS {m}" for m in ("naive24", "mean24")) + " FROM facts GROUP BY target, ts"))
def forecast_wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    wide = rows.groupBy("target", "ts").pivot("model_id", ["naive24", "mean24"]).agg(F.first("y_pred"))
    actual = rows.select("target", "ts", F.col("y_true").alias("actual")).dropDuplicates(["target", "ts"])
    return wide.join(actual, ["target", "ts"]).select("target", stamp("ts").alias("ts"), *[r(c).alias(c) for c in ("actual", "naive24", "mean24")])


@query("P11_short_labels", sql(" SELECT DISTINCT model_id, CASE WHEN model_id LIKE 'naive%' THEN 'SNaive-' || regexp_extract(model_id, '([0-9]+)$', 1) WHEN model_id LIKE 'dup\\_%' ESCAPE '\\' THEN 'Copy of ' || regexp_replace(model_id, '^dup_', '') ELSE upper(model_id) END AS label FROM facts"))
def short_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("model_id")
    label = F.when(m.startswith("naive"), F.concat(F.lit("SNaive-"), F.regexp_extract(m, "([0-9]+)$", 1))).when(m.startswith("dup_"), F.concat(F.lit("Copy of "), F.regexp_replace(m, "^dup_", ""))).otherwise(F.upper(m))
    return facts(spark, sf).select("model_id", label.alias("label")).distinct()

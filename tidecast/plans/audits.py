"""Queries of audits, fitted models, hourly and per-horizon tests, and the stream's batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import audit, dm, features, learners, metrics, splits
from tidecast.plans.base import CALIBRATION, HOURLY, facts, obs, r, sql, stamp
from tidecast.plans.comparison import by_target
from tidecast.plans.preparation import _BOUNDS, _CANDIDATES, _SPLIT_COLUMNS, S, _bounds
from tidecast.plans.registry import ROWS_ONLY, query
from tidecast.sources import tables
from tidecast.streaming import hourly as stream


@query("F03_before_last_year", "WITH o AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders) SELECT year(ts) AS year, count(*) AS n FROM o WHERE ts < (SELECT date_trunc('year', max(ts)) FROM o) GROUP BY 1")
def before_last_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    cut = rows.agg(F.date_trunc("year", F.max("ts")).alias("cut"))
    return rows.join(F.broadcast(cut)).where("ts < cut").groupBy(F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("F04_finite_pairs", "WITH p AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS y, value * 0.9 AS p FROM events) SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae FROM p WHERE y IS NOT NULL AND isfinite(y)")
def finite_pairs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    y = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, None).when(k % 13 == 0, float("inf")).otherwise(F.col("value"))
    rows = tables.table(spark, sf, "events").select(y.alias("y"), (F.col("value") * 0.9).alias("p")).where(audit.finite("y", "p"))
    return rows.agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("y") - F.col("p")))).alias("mae"))


@query("F06_recursion_gaps", sql(" SELECT target, CAST(96 AS BIGINT) AS expected, count(DISTINCT ts) FILTER (ts > TIMESTAMP '2024-01-19 23:00:00' AND ts <= TIMESTAMP '2024-01-23 23:00:00') AS present, 96 - count(DISTINCT ts) FILTER (ts > TIMESTAMP '2024-01-19 23:00:00' AND ts <= TIMESTAMP '2024-01-23 23:00:00') AS missing, count(*) FILTER (ts > TIMESTAMP '2024-01-23 23:00:00') AS beyond FROM obs GROUP BY 1", HOURLY))
def recursion_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return audit.recursion_gaps(obs(spark, sf), "2024-01-19 23:00:00", "2024-01-23 23:00:00")


@query("F07_split_faults", f"{_CANDIDATES}, z AS (SELECT *, CASE WHEN train_start >= train_end THEN 'empty training' WHEN train_end >= test_start THEN 'training reaches the test' WHEN test_end > TIMESTAMP '1996-01-31 23:00:00' THEN 'test beyond the data' ELSE 'ok' END AS fault FROM s WHERE k = 1) SELECT scheme, fault, count(*) AS n FROM z GROUP BY 1, 2")
def split_faults(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.split_faults(splits.rolling_splits(_bounds(spark, sf)), "1996-01-31 23:00:00")
    return out.groupBy("scheme", "fault").agg(F.count("*").alias("n"))


@query("F08_history_ends", f"{_CANDIDATES} SELECT {_SPLIT_COLUMNS}, {S.format('test_start - INTERVAL 1 HOUR')} AS before_test, {S.format('train_end')} AS through_train FROM s WHERE k = 1")
def history_ends(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.rolling_splits(_bounds(spark, sf))
    rows = audit.history_end(rows, "before_test").withColumnRenamed("history_end", "before_test")
    rows = audit.history_end(rows, "through_train").withColumnRenamed("history_end", "through_train")
    return rows.select(*[stamp(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end", "before_test", "through_train")])


@query("F09_history_holes", sql(" , o AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-30', INTERVAL 5 DAY)) AS origin), z AS (SELECT * FROM obs WHERE y > 150) SELECT strftime(origin, '%Y-%m-%d') AS origin, target, count(*) AS found FROM o JOIN z ON ts < origin AND ts >= origin - INTERVAL 168 HOUR GROUP BY o.origin, target", HOURLY))
def history_holes(spark: SparkSession, sf: str) -> DataFrame:
    origins = spark.sql("select explode(sequence(date '2024-01-10', date '2024-01-30', interval 5 days)) as origin")
    out = audit.history_holes(obs(spark, sf).where("y > 150"), origins, 168)
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "target", "found")


@query("F16_trajectory_faults", sql(" , e AS (SELECT model_id, target, date, count(*) AS n, count(DISTINCT horizon) AS d, min(CASE WHEN ts = date + to_hours(CAST(horizon - 1 AS INT)) THEN 1 ELSE 0 END) AS fit FROM facts GROUP BY 1, 2, 3) SELECT model_id, target, count(*) AS origins, count(*) FILTER (n <> 24 OR d <> 24 OR fit <> 1) AS faulty FROM e GROUP BY 1, 2"))
def trajectory_faults(spark: SparkSession, sf: str) -> DataFrame:
    return audit.trajectory_faults(facts(spark, sf))


@query("F17_actual_differences", sql(f" , z AS (SELECT target, ts, CASE WHEN model_id = 'mean24' AND hour(ts) = 4 THEN y_true + 1 ELSE y_true END AS y FROM facts) SELECT target, {S.format('ts')} AS ts, round(max(y) - min(y), 6) AS spread FROM z GROUP BY target, ts HAVING max(y) - min(y) > 1e-12"))
def actual_differences(spark: SparkSession, sf: str) -> DataFrame:
    changed = F.when((F.col("model_id") == "mean24") & (F.hour("ts") == 4), F.col("y_true") + 1).otherwise(F.col("y_true"))
    out = audit.actual_differences(facts(spark, sf).withColumn("y_true", changed))
    return out.select("target", stamp("ts").alias("ts"), r("spread").alias("spread"))


@query("U04_key_differences", sql(f" , a AS (SELECT DISTINCT target, ts FROM facts WHERE horizon <> 3), b AS (SELECT DISTINCT target, ts FROM facts WHERE horizon <> 9) SELECT target, {S.format('ts')} AS ts, side FROM (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"))
def key_differences(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    return audit.key_differences(rows.where("horizon <> 3"), rows.where("horizon <> 9"), ["target", "ts"]).select("target", stamp("ts").alias("ts"), "side")


@query("F21_cell_counts", "WITH f AS (SELECT o_orderpriority AS stratum, o_orderstatus AS state FROM orders) SELECT a.stratum, b.state, count(f.stratum) AS n FROM (SELECT DISTINCT stratum FROM f) a CROSS JOIN (SELECT DISTINCT state FROM f) b LEFT JOIN f ON f.stratum = a.stratum AND f.state = b.state GROUP BY 1, 2")
def cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders")
    return audit.cell_counts(rows.select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("state")), "stratum", "state")


_KINDS = {"l_returnflag": "text", "l_linenumber": "whole", "l_suppkey": "whole", "l_partkey": "whole", "l_quantity": "real"}


@query("M01_classify_columns", "WITH n AS (SELECT count(*) AS n FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct, CASE WHEN '{k}' = 'text' OR ('{k}' = 'whole' AND count(DISTINCT {c}) <= greatest(24, floor(0.02 * (SELECT n FROM n)))) THEN 'categorical' ELSE 'numeric' END AS kind FROM lineitem" for c, k in _KINDS.items()))
def classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    return audit.classify_columns(tables.table(spark, sf, "lineitem"), list(_KINDS))


@query("Q03_linear_walk_forward", sql(" , l AS (SELECT target, ts, y, lag(y, 24) OVER (PARTITION BY target ORDER BY ts) AS x FROM obs), o AS (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-01-30', INTERVAL 1 DAY)) AS origin) SELECT strftime(origin, '%Y-%m-%d') AS origin, target, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(x) AS n FROM o JOIN l ON ts < origin AND x IS NOT NULL GROUP BY o.origin, target", HOURLY))
def linear_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    origins = spark.sql("select explode(sequence(date '2024-01-20', date '2024-01-30', interval 1 day)) as origin")
    out = learners.linear_walk_forward(obs(spark, sf), origins)
    return out.select(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "target", r("slope").alias("slope"), r("intercept").alias("intercept"), "n")


ROWS_ONLY["M07_boosted_forecast"] = "the trees of a gradient-boosting learner are not an SQL expression"


@query("M07_boosted_forecast")
def boosted_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.lag_features(obs(spark, sf).where("target = 'P'"), [24, 168]).where("lag_168 is not null").withColumn("hour", F.hour("ts").cast("double"))
    out = learners.boosted_forecast(rows, ["lag_24", "lag_168", "hour"], "2024-01-20 00:00:00", rounds=5)
    return out.select("target", stamp("ts").alias("ts"), r("y").alias("y"), r("y_pred").alias("y_pred"))


ROWS_ONLY["Q18_block_bootstrap"] = "seeded draws of a random generator are not an SQL expression"


@query("Q18_block_bootstrap")
def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return learners.block_bootstrap_bounds(facts(spark, sf, CALIBRATION), ["model_id", "target"])


@query("A12_legacy_metrics", sql(" , s AS (SELECT target, avg(d) AS scale FROM (SELECT target, abs(y - lag(y, 24) OVER (PARTITION BY target ORDER BY ts)) AS d FROM obs WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1) SELECT model_id, target, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, round(avg(abs(error)) / max(scale), 6) AS mase FROM facts JOIN s USING (target) GROUP BY 1, 2"))
def legacy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scale = metrics.mase_scale(obs(spark, sf), "2024-01-20 00:00:00")
    rows = metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse", "mae"]).join(F.broadcast(scale), "target")
    return rows.select("model_id", "target", r("rmse").alias("rmse"), r("mae").alias("mae"), r(F.col("mae") / F.col("scale")).alias("mase"))


@query("A23_pooled_scales", sql(" , o AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-28', INTERVAL 3 DAY)) AS origin), d AS (SELECT a.target, CAST(a.ts AS DATE) AS date, a.y - b.y AS e FROM obs a JOIN obs b ON a.target = b.target AND b.ts = a.ts - INTERVAL 24 HOUR) SELECT target, count(*) AS n, round(sqrt(avg(e * e)), 6) AS scale FROM d JOIN o ON o.origin = d.date GROUP BY 1", HOURLY))
def pooled_scales(spark: SparkSession, sf: str) -> DataFrame:
    origins = spark.sql("select explode(sequence(date '2024-01-10', date '2024-01-28', interval 3 days)) as date")
    shifted = features.seasonal_shift(obs(spark, sf), 24).withColumns({"date": F.to_date("ts"), "e": F.col("y") - F.col("y_pred")})
    return shifted.join(F.broadcast(origins), "date", "left_semi").groupBy("target").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("scale"))


@query("A25_complete_systems", sql(" , m AS (SELECT model_id, target, sqrt(avg(error * error)) AS rmse FROM facts GROUP BY 1, 2), w AS (SELECT model_id, max(CASE WHEN target = 'P' THEN rmse END) AS p, max(CASE WHEN target = 'Q' THEN rmse END) AS q FROM m GROUP BY 1) SELECT model_id, round(p, 6) AS p, round(q, 6) AS q, round((p / min(p) OVER () + q / min(q) OVER ()) / 2, 6) AS j FROM w"))
def complete_systems(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators import compare

    out = compare.select_system(by_target(spark, sf))
    return out.select("model_id", r("p").alias("p"), r("q").alias("q"), r("score").alias("j"))


@query("A35_relabelled_periods", sql(" , u AS (SELECT *, 'combined' AS period FROM cal UNION ALL SELECT *, 'combined' FROM facts) SELECT model_id, target, period, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse FROM u GROUP BY 1, 2, 3"))
def relabelled_periods(spark: SparkSession, sf: str) -> DataFrame:
    both = facts(spark, sf, CALIBRATION).unionByName(facts(spark, sf)).withColumn("period", F.lit("combined"))
    return metrics.summarise(both, ["model_id", "target", "period"], ["n", "rmse"]).withColumn("rmse", r("rmse"))


@query("P09_period_labels", sql(" SELECT CASE WHEN date < DATE '2024-01-20' THEN 'calibration' WHEN date < DATE '2024-01-28' THEN 'primary' ELSE 'stress' END AS period, model_id, count(*) AS n FROM allfacts GROUP BY 1, 2"))
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, (CALIBRATION[0], "2024-01-30"))
    period = F.when(F.col("date") < "2024-01-20", "calibration").when(F.col("date") < "2024-01-28", "primary").otherwise("stress")
    return rows.groupBy(period.alias("period"), "model_id").agg(F.count("*").alias("n"))


_HOURLY_PAIRS = """ , pr AS (SELECT a.target, a.ts, a.model_id AS model_a, b.model_id AS model_b, a.error * a.error - b.error * b.error AS d FROM facts a JOIN facts b ON a.target = b.target AND a.ts = b.ts AND a.model_id < b.model_id),
ce AS (SELECT *, d - avg(d) OVER w AS c, row_number() OVER (PARTITION BY target, model_a, model_b ORDER BY ts) AS i FROM pr WINDOW w AS (PARTITION BY target, model_a, model_b)),
st AS (SELECT target, model_a, model_b, count(*) AS n, avg(d) AS m, avg(c * c) AS g0 FROM ce GROUP BY 1, 2, 3),
ac AS (SELECT x.target, x.model_a, x.model_b, y.i - x.i AS l, sum(x.c * y.c) AS s FROM ce x JOIN ce y ON x.target = y.target AND x.model_a = y.model_a AND x.model_b = y.model_b AND y.i > x.i AND y.i <= x.i + 23 GROUP BY ALL),
va AS (SELECT st.*, (g0 + (SELECT sum(2 * (1 - l / 24.0) * s / n) FROM ac WHERE ac.target = st.target AND ac.model_a = st.model_a AND ac.model_b = st.model_b)) / n AS v FROM st)"""


@query("Q20_hourly_dm", sql(_HOURLY_PAIRS + " SELECT target, model_a, model_b, n, round(m, 3) AS mean_difference, round(CASE WHEN v > 1e-15 THEN m / (sqrt(v) / sqrt((n + 1 - 48 + 24 * 23 / n) / n)) END, 6) AS statistic FROM va"))
def hourly_dm(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("loss", F.col("error") * F.col("error"))
    tests = dm.dm_tests(dm.pair_differences(rows, ["target", "ts"]), ["target", "model_a", "model_b"], "ts", lag=23, horizon=24, least=25)
    return tests.select("target", "model_a", "model_b", "n", r("mean_difference", 3).alias("mean_difference"), r("statistic").alias("statistic"))


@query("Q36_loss_vectors", sql(f" SELECT model_id, target, {S.format('ts')} AS ts, loss, round(CASE loss WHEN 'squared' THEN error * error ELSE abs(error) END, 3) AS value FROM facts, (VALUES ('squared'), ('absolute')) v(loss) WHERE model_id = 'mean24'"))
def loss_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).where("model_id = 'mean24'").withColumn("loss", F.explode(F.array(F.lit("squared"), F.lit("absolute"))))
    value = F.when(F.col("loss") == "squared", F.col("error") * F.col("error")).otherwise(F.abs("error"))
    return rows.select("model_id", "target", stamp("ts").alias("ts"), "loss", r(value, 3).alias("value"))


@query("G07_clipped_bounds", f"WITH {_BOUNDS} SELECT {S.format('greatest(first, TIMESTAMP ' + repr('1994-06-01') + ')')} AS start, {S.format('least(last, TIMESTAMP ' + repr('1999-01-01') + ')')} AS stop FROM b")
def clipped_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bounds(spark, sf)
    start = F.greatest(F.col("first"), F.lit("1994-06-01").cast("timestamp_ntz"))
    stop = F.least(F.col("last"), F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.select(F.date_format(start, tables.STAMP).alias("start"), F.date_format(stop, tables.STAMP).alias("stop"))


@query("G08_origins_and_gaps", "SELECT strftime(o, '%Y-%m-%d') AS origin, CAST(g AS INT) AS gap, strftime(o - INTERVAL 1 HOUR - to_hours(CAST(g AS INT)), '%Y-%m-%d %H:%M:%S') AS fit_end FROM generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-28', INTERVAL 1 DAY) t(o), (VALUES (0), (24), (72), (168)) v(g)")
def origins_and_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql("select explode(sequence(timestamp_ntz '2024-01-24 00:00:00', timestamp_ntz '2024-01-28 00:00:00', interval 1 day)) as o")
    rows = rows.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in (0, 24, 72, 168)])))
    return rows.select(F.date_format("o", "yyyy-MM-dd").alias("origin"), "gap", F.date_format(F.expr("o - interval 1 hour - make_dt_interval(0, gap)"), tables.STAMP).alias("fit_end"))


@query("ST_hourly_events", f"SELECT {S.format('date_trunc(' + repr('hour') + ', ts)')} AS ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    out = stream.hourly_batch(tables.table(spark, sf, "events"))
    return out.select(stamp("ts").alias("ts"), "event_type", "n", r("total").alias("total"))

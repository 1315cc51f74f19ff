"""Queries of joins, unions and choices that the stages are made of, and audits that put several rules together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.operators import audit, compare, dm, guards, metrics, planner, splits
from tidecast.plans.audits import _CANDIDATES, _bounds
from tidecast.plans.base import HOURLY, facts, r, sql, stamp
from tidecast.plans.comparison import _AUTO, _DAILY, _DM, _LOSSES, _P, _SIGN, beyond, hourly_losses, pair_tests, signed
from tidecast.plans.evaluation import POINT, S, day
from tidecast.plans.inference import _INTERVAL_NAMES, _INTERVALS, _IV, _SCALE, CONTRASTS, _scale, interval_means, predictive_rows
from tidecast.plans.registry import query
from tidecast.plans.search import FEATURES, _features
from tidecast.sources import tables


@query("P16_dynamic_features", f"WITH f AS (SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature), m AS (SELECT feature, regexp_extract(feature, '^(P_Power|Q_Power)_(lag|rmean|rstd)_([0-9]+)$', ['owner', 'kind', 'hours']) AS x FROM f) SELECT feature, nullif(x.kind, '') AS kind, nullif(x.owner, '') AS owner, TRY_CAST(x.hours AS INT) AS hours FROM m")
def dynamic_features(spark: SparkSession, sf: str) -> DataFrame:
    found = planner.catalogue(_features(spark), ["P_Power", "Q_Power"])
    dynamic = (F.col("kind") != "static") & F.col("owner").isNotNull()
    return found.select("feature", *[F.when(dynamic, F.col(c)).alias(c) for c in ("kind", "owner", "hours")])


@query("F19_grid_audit", sql(" , o AS (SELECT 'P' AS target, ts, p AS y FROM ev UNION ALL SELECT 'Q', ts, q FROM ev) SELECT target, (SELECT count(*) FROM grid) AS expected, count(DISTINCT ts) AS present, (SELECT count(*) FROM grid) - count(DISTINCT ts) AS missing, count(*) - count(DISTINCT ts) AS repeated, count(*) FILTER (y IS NULL OR NOT isfinite(y)) AS not_finite, count(*) FILTER (ts < (SELECT min(ts) FROM ev) + INTERVAL 168 HOUR) AS history FROM o GROUP BY 1", HOURLY))
def grid_audit(spark: SparkSession, sf: str) -> DataFrame:
    sums = tables.hourly_sums(tables.table(spark, sf, "events"))
    return audit.grid_audit(tables.observations(sums), 168)


@query("F20_split_rules", f"{_CANDIDATES}, z AS (SELECT scheme, date_diff('hour', test_start, test_end) = 23 AS whole_day, date_diff('hour', train_end, test_start) // 24 AS gap_days, train_start < train_end AND train_end < test_start AND test_start < test_end AS in_order FROM s WHERE k = 1) SELECT scheme, count(*) AS n, count(*) FILTER (whole_day) AS whole_days, count(*) FILTER (in_order) AS in_order, CAST(min(gap_days) AS BIGINT) AS least_gap, CAST(max(gap_days) AS BIGINT) AS most_gap FROM z GROUP BY 1")
def split_rules(spark: SparkSession, sf: str) -> DataFrame:
    return audit.split_rules(splits.rolling_splits(_bounds(spark, sf)))


_RANGES = [("whole", "1995-01-01", "2001-07-31"), ("early", "1994-06-01", "1995-06-01"), ("late", "2001-01-01", "2002-01-01"), ("backwards", "1996-01-01", "1995-01-01")]


@query("F12_configuration_audit", "WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT name, CAST(a AS DATE) AS a, CAST(z AS DATE) AS z FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{z}')" for n, a, z in _RANGES) + ") v(name, a, z)) SELECT name, CASE WHEN a > z THEN 'ends before it begins' WHEN a < first THEN 'begins before the data' WHEN z > last THEN 'ends after the data' WHEN (SELECT count(*) FROM d WHERE d BETWEEN a AND z) < date_diff('day', a, z) + 1 THEN 'a day is missing' ELSE 'ok' END AS verdict FROM c, b")
def configuration_audit(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    ranges = spark.createDataFrame(_RANGES, "name string, a string, z string").select("name", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    return audit.configurations(ranges, days)


@query("J03_days_by_hours", sql(f" , d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM ev) SELECT {S.format('d + to_hours(CAST(h AS INT))')} AS ts, ev.ts IS NOT NULL AS present FROM d CROSS JOIN range(24) t(h) LEFT JOIN ev ON ev.ts = d + to_hours(CAST(h AS INT))", HOURLY))
def days_by_hours(spark: SparkSession, sf: str) -> DataFrame:
    sums = tables.hourly_sums(tables.table(spark, sf, "events"))
    hours = sums.select(F.to_date("ts").cast("timestamp_ntz").alias("d")).distinct().select(F.explode(F.expr("sequence(d, d + interval 23 hours, interval 1 hour)")).alias("ts"))
    return hours.join(sums.select("ts", F.lit(True).alias("there")), "ts", "left").select(stamp("ts").alias("ts"), F.col("there").isNotNull().alias("present"))


@query("J04_paired_errors", sql(" SELECT p.model_id, strftime(p.date, '%Y-%m-%d') AS date, CAST(p.horizon AS INT) AS horizon, round(p.error, 6) AS e_p, round(q.error, 6) AS e_q FROM facts p JOIN facts q USING (model_id, date, horizon) WHERE p.target = 'P' AND q.target = 'Q'"))
def paired_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows, key = facts(spark, sf), ["model_id", "date", "horizon"]
    sides = [rows.where(F.col("target") == t).select(*key, F.col("error").alias(f"e_{t.lower()}")) for t in "PQ"]
    out = guards.one_to_one(*sides, key)
    return out.select("model_id", day(), "horizon", r("e_p").alias("e_p"), r("e_q").alias("e_q"))


@query("W16_canonical_systems", sql(_SIGN + " , w AS (SELECT model_id, string_agg(signature, ',' ORDER BY target) AS signature, CASE WHEN model_id = 'naive24' THEN 0 ELSE 1 END AS priority FROM sg GROUP BY 1) SELECT model_id, first_value(model_id) OVER (PARTITION BY signature ORDER BY priority, model_id) AS canonical FROM w"))
def canonical_systems(spark: SparkSession, sf: str) -> DataFrame:
    both = signed(spark, sf).groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "signature"))), lambda x: x["signature"]), ",").alias("signature"))
    both = both.withColumn("priority", F.when(F.col("model_id") == "naive24", 0).otherwise(1))
    return compare.collapse_duplicates(both, [], "priority").select("model_id", "canonical")


@query("L01_first_by_several_keys", sql(f" , m AS (SELECT model_id, target, {POINT['rmse']} AS rmse FROM facts GROUP BY 1, 2), w AS (SELECT model_id, max(CASE WHEN target = 'P' THEN rmse END) AS p, max(CASE WHEN target = 'Q' THEN rmse END) AS q FROM m GROUP BY 1) SELECT model_id, round(p, 6) AS p, round(q, 6) AS q FROM w ORDER BY round(p, 9), round(q, 9), model_id LIMIT 1"))
def first_by_several_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse"])
    wide = rows.groupBy("model_id").pivot("target", ["P", "Q"]).agg(F.max("rmse"))
    return wide.orderBy(F.round("P", 9), F.round("Q", 9), "model_id").limit(1).select("model_id", r("P").alias("p"), r("Q").alias("q"))


@query("U01_union_of_years", "SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM orders GROUP BY 1")
def union_of_years(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    years = [rows.where(F.col("year") == y).select("year", "o_totalprice") for y in range(1992, 2003)]
    union = years[0]
    for part in years[1:]:
        union = union.unionByName(part)
    return union.groupBy("year").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 3).alias("total"))


@query("U06_distinct_by_keys", "SELECT l_suppkey, l_returnflag, min(l_shipdate) = max(l_shipdate) AS one_day FROM lineitem GROUP BY 1, 2")
def distinct_by_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem")
    keys = rows.select("l_suppkey", "l_returnflag").dropDuplicates(["l_suppkey", "l_returnflag"])
    days = rows.groupBy("l_suppkey", "l_returnflag").agg((F.min("l_shipdate") == F.max("l_shipdate")).alias("one_day"))
    return keys.join(days, ["l_suppkey", "l_returnflag"])


@query("U09_equal_predictions", sql(" , g AS (SELECT model_id, target, count(*) AS n FROM facts GROUP BY 1, 2) SELECT a.target, a.model_id AS model_a, b.model_id AS model_b, count(*) AS common, max(x.n) AS n_a, max(y.n) AS n_b, count(*) = max(x.n) AND count(*) = max(y.n) AND max(abs(a.y_pred - b.y_pred)) <= 1e-9 AS equal FROM facts a JOIN facts b ON a.target = b.target AND a.ts = b.ts AND a.model_id < b.model_id JOIN g x ON x.model_id = a.model_id AND x.target = a.target JOIN g y ON y.model_id = b.model_id AND y.target = b.target GROUP BY 1, 2, 3"))
def equal_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return compare.equal_predictions(facts(spark, sf), 1e-9)


_FAMILY = ["mean24", "naive24", "hourmean7d"]
_OF_THREE = " , dmf AS (SELECT * FROM dmp WHERE model_a IN ('mean24', 'naive24', 'hourmean7d') AND model_b IN ('mean24', 'naive24', 'hourmean7d'))"


@query("Q30_family_tests", sql(_DAILY + _DM.format(lag=_AUTO) + _P + _OF_THREE + ", fk AS (SELECT *, row_number() OVER (PARTITION BY target, loss ORDER BY p_value, model_a, model_b) AS fk, count(p_value) OVER (PARTITION BY target, loss) AS fm FROM dmf) SELECT target, loss, model_a, model_b, round(p_value, 6) AS p_value, round(max(least(1, (fm - fk + 1) * p_value)) OVER (PARTITION BY target, loss ORDER BY fk), 6) AS p_holm FROM fk"))
def family_tests(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.plans.comparison import daily_long

    rows = daily_long(spark, sf).where(F.col("model_id").isin(_FAMILY))
    tests = dm.dm_tests(dm.pair_differences(rows, ["target", "loss", "date"], "v"), ["target", "loss", "model_a", "model_b"], "date")
    tests = dm.holm(tests, ["target", "loss"], ties=["model_a", "model_b"])
    return tests.select("target", "loss", "model_a", "model_b", r("p_value").alias("p_value"), r("p_holm").alias("p_holm"))


_PLANNED_11 = """, lo AS (SELECT model_id, target, date, round(avg(error * error), 8) AS v FROM facts GROUP BY 1, 2, 3),
pr AS (SELECT p.target, c.contrast AS loss, p.date, c.a AS model_a, c.b AS model_b, p.v - q.v AS d FROM (VALUES """ + ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in CONTRASTS) + ") c(contrast, a, b), lo p, lo q WHERE p.model_id = c.a AND q.model_id = c.b AND p.target = q.target AND p.date = q.date)"


@query("Q31_family_at_fixed_lag", sql(_PLANNED_11 + _DM[_DM.index(",\nce AS") :].format(lag=3) + _P + " SELECT target, loss AS contrast, CAST(hac_lag AS INT) AS hac_lag, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM dmp"))
def family_at_fixed_lag(spark: SparkSession, sf: str) -> DataFrame:
    daily = facts(spark, sf).groupBy("model_id", "target", "date").agg(F.round(F.avg(F.col("error") * F.col("error")), 8).alias("v"))
    contrasts = spark.createDataFrame(CONTRASTS, "contrast string, model_a string, model_b string")
    tests = dm.dm_tests(dm.planned_differences(daily, contrasts, ["target", "date"], "v"), ["target", "contrast"], "date", lag=3)
    return tests.select("target", "contrast", "hac_lag", r("statistic").alias("statistic"), r("p_value").alias("p_value"))


_MODELS = ["dup_naive24", "hourmean7d", "mean24", "naive168", "naive24"]


@query("Q35_p_value_matrix", sql(_DAILY + _DM.format(lag=_AUTO) + _P + f" , c AS (SELECT target, loss, model_a AS model_id, model_b AS other, p_holm FROM pairs UNION ALL SELECT target, loss, model_b, model_a, p_holm FROM pairs) SELECT target, loss, model_id, {', '.join(f'''round(max(CASE WHEN other = '{m}' THEN p_holm END), 6) AS {m}''' for m in _MODELS)} FROM c GROUP BY 1, 2, 3"))
def p_value_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = dm.matrix_cells(pair_tests(spark, sf), ["target", "loss"], "p_holm", False, 1.0).where("row <> col")
    wide = cells.groupBy("target", "loss", F.col("row").alias("model_id")).pivot("col", _MODELS).agg(F.max("value"))
    return wide.select("target", "loss", "model_id", *[r(m).alias(m) for m in _MODELS])


@query("A15_system_metrics", sql(_SCALE.replace(",", " ,", 1) + f", m AS (SELECT model_id, target, {', '.join(f'{POINT[k]} AS {k}' for k in ('rmse', 'mae', 'wmape'))} FROM facts GROUP BY 1, 2), z AS (SELECT target, rmse AS base FROM m WHERE model_id = 'naive24'), w AS (SELECT model_id, avg(rmse / base) AS paired, avg(mae / scale) AS mase, avg(wmape) AS wmape FROM m JOIN z USING (target) JOIN sc USING (target) GROUP BY 1) SELECT model_id, round(paired, 6) AS paired, round(mase, 6) AS mase, round(wmape, 6) AS wmape, CAST(rank() OVER (ORDER BY round(paired, 9)) AS INT) AS rank_paired, CAST(rank() OVER (ORDER BY round(mase, 9)) AS INT) AS rank_mase FROM w"))
def system_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse", "mae", "wmape"])
    base = F.broadcast(rows.where("model_id = 'naive24'").select("target", F.col("rmse").alias("base")))
    got = rows.join(base, "target").join(_scale(spark, sf), "target").groupBy("model_id").agg(F.avg(F.col("rmse") / F.col("base")).alias("paired"), F.avg(F.col("mae") / F.col("scale")).alias("mase"), F.avg("wmape").alias("wmape"))
    place = lambda c: F.rank().over(W.orderBy(F.round(c, 9)))
    return got.select("model_id", *[r(c).alias(c) for c in ("paired", "mase", "wmape")], place("paired").alias("rank_paired"), place("mase").alias("rank_mase"))


@query("A37_probabilistic_summary", sql(_LOSSES + _IV + f", it AS (SELECT model_id, {_INTERVALS} FROM iv GROUP BY 1), pl AS (SELECT model_id, avg(crps) AS crps, avg(pb) AS pinball FROM hl GROUP BY 1) SELECT model_id, {', '.join(f'round({c}, 6) AS {c}' for c in ['crps', 'pinball', *_INTERVAL_NAMES])} FROM it JOIN pl USING (model_id)"))
def probabilistic_summary(spark: SparkSession, sf: str) -> DataFrame:
    losses = hourly_losses(spark, sf).groupBy("model_id").agg(F.avg("crps").alias("crps"), F.avg("pb").alias("pinball"))
    got = losses.join(interval_means(predictive_rows(spark, sf)[1], ["model_id"]), "model_id")
    return got.select("model_id", *[r(c).alias(c) for c in ("crps", "pinball", *_INTERVAL_NAMES)])


@query("H04_critical_values", f"WITH RECURSIVE d AS (SELECT unnest(range(2, 62)) AS n), tq AS (SELECT n, 0.0::DOUBLE AS low, pi() / 2 AS high, 0 AS i FROM d UNION ALL SELECT n, CASE WHEN p > 0.05 THEN middle ELSE low END, CASE WHEN p > 0.05 THEN high ELSE middle END, i + 1 FROM (SELECT *, {beyond('middle', 'n')} AS p FROM (SELECT *, (low + high) / 2 AS middle FROM tq WHERE i < 55))) SELECT CAST(n - 1 AS BIGINT) AS df, round(sqrt(n - 1.0) * tan(low), 6) AS t FROM tq WHERE i = 55")
def critical_values(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 61).select(F.col("id").alias("df"), r(dm.t_critical(F.col("id"))).alias("t"))


@query("F25_input_audit", sql(" , o AS (SELECT 'P' AS target, ts, p AS y FROM ev UNION ALL SELECT 'Q', ts, q FROM ev), g AS (SELECT 'grid' AS rule, target AS subject, count(DISTINCT ts) = (SELECT count(*) FROM grid) AND count(*) = count(DISTINCT ts) AND count(*) FILTER (y IS NULL OR NOT isfinite(y)) = 0 AS passed FROM o GROUP BY 2), " + _CANDIDATES.removeprefix("WITH ") + ", z AS (SELECT 'splits' AS rule, scheme AS subject, bool_and(date_diff('hour', test_start, test_end) = 23 AND train_start < train_end AND train_end < test_start) AS passed FROM s WHERE k = 1 GROUP BY 2), sd AS (SELECT target, abs(y - lag(y, 24) OVER (PARTITION BY target ORDER BY ts)) AS d FROM obs WHERE ts < TIMESTAMP '2024-01-20'), sc AS (SELECT 'scale' AS rule, target AS subject, avg(d) > 0 AS passed FROM sd GROUP BY 2) SELECT * FROM g UNION ALL SELECT * FROM z UNION ALL SELECT * FROM sc", HOURLY))
def input_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule on the inputs with its subject and whether it holds; a run starts only if all do."""
    grid = grid_audit(spark, sf).select(F.lit("grid").alias("rule"), F.col("target").alias("subject"), F.expr("missing = 0 and repeated = 0 and not_finite = 0").alias("passed"))
    rules = split_rules(spark, sf).select(F.lit("splits").alias("rule"), F.col("scheme").alias("subject"), F.expr("whole_days = n and in_order = n").alias("passed"))
    scales = _scale(spark, sf).select(F.lit("scale").alias("rule"), F.col("target").alias("subject"), (F.col("scale") > 0).alias("passed"))
    return grid.unionByName(rules).unionByName(scales)

"""Queries of the preparation stage: scans, grids, calendar, season, solar, holidays, lags, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.operators import features, grid, splits
from tidecast.plans.base import HOURLY, hourly, obs, r, sql, stamp
from tidecast.plans.registry import query
from tidecast.sources import tables

S = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("S01_scan_hourly_pair", sql(f" SELECT {S.format('ts')} AS ts, round(p, 6) AS p, round(q, 6) AS q FROM hourly", HOURLY))
def scan_hourly_pair(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select(stamp("ts").alias("ts"), r("p").alias("p"), r("q").alias("q"))


@query("S04_audit_grid", """WITH h AS (SELECT date_trunc('hour', ts) AS ts, value FROM events) SELECT count(*) AS n_rows, count(DISTINCT ts) AS n_hours, date_diff('hour', min(ts), max(ts)) + 1 AS span_hours, date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS missing, count(*) - count(DISTINCT ts) AS repeated, CAST(0 AS BIGINT) AS off_grid, CAST(0 AS BIGINT) AS bad_values FROM h""")
def audit_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "events").select(tables.hour_of("ts").alias("ts"), "value")
    return grid.audit_grid(rows, values=["value"])


@query("S12_normalise_predictions", """WITH e AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS y_true, avg(value) AS y_pred FROM events GROUP BY 1) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS horizon, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def normalise_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    text = tables.table(spark, sf, "events").groupBy(stamp("ts").substr(1, 13).alias("h")).agg(F.sum("value").cast("string").alias("y_true"), F.avg("value").cast("string").alias("y_pred"))
    rows = text.select(F.try_to_timestamp(F.col("h"), F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz").alias("ts"), F.col("y_true").try_cast("double").alias("y_true"), F.col("y_pred").try_cast("double").alias("y_pred"))
    rows = rows.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20' and y_true is not null and y_pred is not null")
    horizon = F.row_number().over(W.partitionBy(F.to_date("ts")).orderBy("ts"))
    return rows.select(stamp("ts").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("date"), horizon.alias("horizon"), r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


@query("F05_missing_hours", sql(f", have AS (SELECT DISTINCT ts FROM ev WHERE q > 300) SELECT {S.format('g.ts')} AS ts FROM grid g ANTI JOIN have USING (ts)", HOURLY))
def missing_hours(spark: SparkSession, sf: str) -> DataFrame:
    sums = tables.hourly_sums(tables.table(spark, sf, "events"))
    return grid.missing_hours(sums.where("q > 300"), tables.hourly_grid(sums)).select(stamp("ts").alias("ts"))


@query("F11_complete_days", sql(" SELECT strftime(ts, '%Y-%m-%d') AS date FROM ev WHERE p > 50 GROUP BY 1 HAVING count(*) = 24", HOURLY))
def complete_days(spark: SparkSession, sf: str) -> DataFrame:
    sums = tables.hourly_sums(tables.table(spark, sf, "events")).where("p > 50")
    return grid.complete_days(sums).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("W11_keep_last", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return grid.keep_last(tables.table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("F01_outliers", sql(f""", t AS (SELECT target, ts, y, avg(y) OVER (PARTITION BY target ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS trend FROM obs)
SELECT target, {S.format('ts')} AS ts, CASE WHEN abs(y - trend) > 550 OR y < 100 OR (trend - y) / nullif(y, 0) > 1 THEN NULL ELSE round(y, 6) END AS y FROM t""", HOURLY))
def outliers(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators.decompose import null_outliers

    return null_outliers(obs(spark, sf)).select("target", stamp("ts").alias("ts"), r("y").alias("y"))


@query("H01_classical_decomposition", sql(f""", t AS (SELECT target, ts, y, avg(y) OVER (PARTITION BY target ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS trend FROM obs),
s AS (SELECT *, avg(y - trend) OVER (PARTITION BY target, hour(ts)) AS daily FROM t), w AS (SELECT *, avg(y - trend - daily) OVER (PARTITION BY target, isodow(ts), hour(ts)) AS weekly FROM s)
SELECT target, {S.format('ts')} AS ts, round(trend, 6) AS trend, round(daily, 6) AS daily, round(weekly, 6) AS weekly, round(y - trend - daily - weekly, 6) AS resid FROM w""", HOURLY))
def classical_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators.decompose import decompose

    return decompose(obs(spark, sf)).select("target", stamp("ts").alias("ts"), *[r(c).alias(c) for c in ("trend", "daily", "weekly", "resid")])


@query("H02_fill_gaps", sql(f""", z AS (SELECT target, ts, nullif(y, 0) AS y FROM (SELECT target, g.ts, CASE target WHEN 'P' THEN e.p ELSE e.q END AS y FROM grid g CROSS JOIN (VALUES ('P'), ('Q')) t(target) LEFT JOIN ev e ON e.ts = g.ts)),
f AS (SELECT *, avg(y) OVER (PARTITION BY target, isodow(ts), hour(ts)) AS m FROM z) SELECT target, {S.format('ts')} AS ts, round(coalesce(y, m), 6) AS filled, CASE WHEN y IS NULL THEN 1 ELSE 0 END AS was_missing FROM f""", HOURLY))
def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators.decompose import fill_gaps as fill

    sums = tables.hourly_sums(tables.table(spark, sf, "events"))
    rows = tables.observations(tables.hourly_grid(sums).join(sums, "ts", "left"))
    return fill(rows).select("target", stamp("ts").alias("ts"), r("filled").alias("filled"), "was_missing")


@query("P01_fixed_offset", """SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def fixed_offset(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "events").select("event_id", stamp("ts").alias("t"))
    return rows.select("event_id", F.date_format(calendar.fixed_utc2(F.col("t")), tables.STAMP).alias("utc"))


@query("P02_civil_time", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT strftime(d, '%Y-%m-%d') AS d, strftime((CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv', '%Y-%m-%d %H:%M:%S') AS civil FROM d""")
def civil_time(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    noon = F.to_timestamp(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 12:00:00")))
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("d"), F.date_format(calendar.civil(noon), tables.STAMP).alias("civil"))


_CYCLES = ", ".join(f"round(sin(2 * pi() * {v} / {p}.0), 6) AS {n}_sin, round(cos(2 * pi() * {v} / {p}.0), 6) AS {n}_cos" for n, v, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("doy", "dayofyear(ts)", 366)))


@query("P03_calendar_features", sql(f" SELECT {S.format('ts')} AS ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(day(ts) AS INT) AS dom, CAST(month(ts) AS INT) AS month, CAST(dayofyear(ts) AS INT) AS doy, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, {_CYCLES} FROM hourly", HOURLY))
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendar.calendar_features(hourly(spark, sf).select("ts"))
    return rows.select(stamp("ts").alias("ts"), "hour", "dow", "dom", "month", "doy", "is_weekend", *[r(f"{n}_{f}").alias(f"{n}_{f}") for n in ("hour", "dow", "doy") for f in ("sin", "cos")])


#: Fixed dates of the fixture's holidays.
HOLIDAYS = ["1995-01-01", "1995-01-07", "1995-05-01", "1995-12-25", "1996-01-01", "1996-01-07", "1996-03-08", "1996-12-25", "1997-01-01", "1998-08-24"]


@query("P04_holiday_features", f"""WITH h(d) AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in HOLIDAYS)}])), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS d, CAST(d IN (SELECT d FROM h) AS INT) AS is_holiday, CAST(d + 1 IN (SELECT d FROM h) AS INT) AS is_day_before_hol, CAST(d - 1 IN (SELECT d FROM h) AS INT) AS is_day_after_hol, CAST(isodow(d) >= 6 AS INT) AS is_weekend, CAST(strftime(d, '%m-%d') = '01-01' AS INT) AS is_new_year, CAST(strftime(d, '%m-%d') = '12-25' AS INT) AS is_dec25, CASE WHEN dayofyear(d) <= 14 THEN round(exp(-(dayofyear(d) - 1) / 3.0), 6) ELSE 0.0 END AS post_ny_decay FROM o""")
def holiday_features(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    holidays = spark.createDataFrame([(d,) for d in HOLIDAYS], "d string").select(F.to_date("d").alias("d"))
    out = calendar.holiday_features(days, holidays, "day")
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "is_holiday", "is_day_before_hol", "is_day_after_hol", "is_weekend", "is_new_year", "is_dec25", r("post_ny_decay").alias("post_ny_decay"))


@query("P05_daylight", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), s AS (SELECT d, 480 - dayofyear(d) AS sunrise, 480 + 3 * dayofyear(d) + 30 / 60.0 AS len FROM d)
SELECT strftime(d, '%Y-%m-%d') AS d, CAST(h AS INT) AS hour, round(sin(pi() * greatest(0, least(1, (h * 60 - sunrise) / len))), 5) AS daylight_intensity FROM s, range(24) t(h)""")
def daylight(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    doy = F.dayofyear("d")
    minutes = 480 + 3 * doy
    text = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m 30s"))
    rows = days.select("d", (480 - doy).alias("sunrise"), calendar.day_length_minutes(text).alias("len"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return rows.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "hour", calendar.daylight(F.col("hour") * 60, F.col("sunrise"), F.col("len")).alias("daylight_intensity"))


_SEASON = """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT d, CASE WHEN month(d) = 12 THEN make_date(year(d), 12, 1) WHEN month(d) <= 2 THEN make_date(year(d) - 1, 12, 1) ELSE make_date(year(d), month(d) - month(d) % 3, 1) END AS a, (month(d) % 12) // 3 AS i FROM d),
l AS (SELECT *, date_diff('day', a, CAST(a + INTERVAL 3 MONTH AS DATE)) AS n, date_diff('day', a, d) AS k FROM s)
SELECT strftime(d, '%Y-%m-%d') AS d, CAST({i} AS INT) AS season_idx, CAST(n AS INT) AS season_len, CAST(k + 1 AS INT) AS day_in_season, round(sin(2 * pi() * {i} / 4.0), 6) AS season_sin, round(cos(2 * pi() * k / n), 6) AS season_phase_cos FROM l"""


def _season(spark: SparkSession, sf: str, south: bool) -> DataFrame:
    days = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    out = calendar.season_features(days, "d", south)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "season_idx", "season_len", "day_in_season", r("season_sin").alias("season_sin"), r("season_phase_cos").alias("season_phase_cos"))


@query("P07_season_north", _SEASON.replace("{i}", "i"))
def season_north(spark: SparkSession, sf: str) -> DataFrame:
    return _season(spark, sf, south=False)


@query("P07_season_south", _SEASON.replace("{i}", "((i + 2) % 4)"))
def season_south(spark: SparkSession, sf: str) -> DataFrame:
    return _season(spark, sf, south=True)


@query("J01_feature_join", sql(f" SELECT {S.format('h.ts')} AS ts, round(h.p, 6) AS p, round(10 + 5 * sin(2 * pi() * hour(h.ts) / 24.0), 6) AS temperature, CAST(isodow(h.ts) - 1 AS INT) AS weekday FROM hourly h", HOURLY))
def feature_join(spark: SparkSession, sf: str) -> DataFrame:
    pair = hourly(spark, sf)
    weather = tables.hourly_grid(pair).select("ts", (10 + 5 * calendar.cycle(F.hour("ts"), 24)[0]).alias("temperature"))
    return pair.join(weather, "ts").select(stamp("ts").alias("ts"), r("p").alias("p"), r("temperature").alias("temperature"), F.weekday("ts").alias("weekday"))


@query("J02_full_outer", f"""WITH a AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS p FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS q FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT {S.format('coalesce(a.ts, b.ts)')} AS ts, round(p, 6) AS p, round(q, 6) AS q FROM a FULL JOIN b ON a.ts = b.ts""")
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events")
    sides = [events.where(F.col("event_type") == kind).groupBy(tables.hour_of("ts").alias("ts")).agg(F.sum("value").alias(name)) for kind, name in (("error", "p"), ("signup", "q"))]
    return sides[0].join(sides[1], "ts", "full").select(stamp("ts").alias("ts"), r("p").alias("p"), r("q").alias("q"))


@query("J08_seasonal_shift", sql(f" SELECT o.target, {S.format('o.ts')} AS ts, round(o.y, 6) AS y, round(s.y, 6) AS y_pred FROM obs o JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 24 HOUR", HOURLY))
def seasonal_shift(spark: SparkSession, sf: str) -> DataFrame:
    return features.seasonal_shift(obs(spark, sf), 24).select("target", stamp("ts").alias("ts"), r("y").alias("y"), r("y_pred").alias("y_pred"))


_ROLL = "avg(y) OVER (PARTITION BY target ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


@query("W01_lag_features", sql(f" SELECT target, {S.format('ts')} AS ts, round(lag(y, 1) OVER w, 6) AS lag_1, round(lag(y, 24) OVER w, 6) AS lag_24, round(lag(y, 168) OVER w, 6) AS lag_168 FROM obs WINDOW w AS (PARTITION BY target ORDER BY ts)", HOURLY))
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.lag_features(obs(spark, sf), [1, 24, 168]).select("target", stamp("ts").alias("ts"), *[r(f"lag_{k}").alias(f"lag_{k}") for k in (1, 24, 168)])


@query("W02_rolling_features", sql(f" SELECT target, {S.format('ts')} AS ts, " + ", ".join(f"round({_ROLL.format(w=w)}, 6) AS rmean_{w}, round({_ROLL.format(w=w).replace('avg', 'stddev_samp', 1)}, 6) AS rstd_{w}" for w in (24, 168)) + " FROM obs", HOURLY))
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.rolling_features(obs(spark, sf), [24, 168]).select("target", stamp("ts").alias("ts"), *[r(f"{n}_{w}").alias(f"{n}_{w}") for w in (24, 168) for n in ("rmean", "rstd")])


@query("F02_drop_incomplete_rows", sql(" , l AS (SELECT target, ts, y, lag(y, 24) OVER (PARTITION BY target ORDER BY ts) AS lag_24 FROM obs) SELECT target, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM l WHERE lag_24 IS NOT NULL GROUP BY 1", HOURLY))
def drop_incomplete_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.lag_features(obs(spark, sf), [24]).na.drop()
    return rows.groupBy("target").agg(F.count("*").alias("n"), stamp(F.min("ts")).alias("first"))


def _by_time(population: str) -> str:
    return sql(f""" , w AS (SELECT target, ts, avg(y) OVER x AS m, {population}(y) OVER x AS s, count(y) OVER x AS n FROM obs WINDOW x AS (PARTITION BY target ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING))
SELECT target, {S.format('ts')} AS ts, round(m, 6) AS rmean, round(s, 6) AS rstd, n AS n_back FROM w""", HOURLY)


@query("W04_rolling_by_time", _by_time("stddev_samp"))
def rolling_by_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.rolling_by_time(obs(spark, sf), 24)
    return rows.select("target", stamp("ts").alias("ts"), r("rmean").alias("rmean"), r("rstd").alias("rstd"), "n_back")


@query("W05_rolling_population", _by_time("stddev_pop"))
def rolling_population(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.rolling_by_time(obs(spark, sf), 24, population=True)
    return rows.select("target", stamp("ts").alias("ts"), r("rmean").alias("rmean"), r("rstd").alias("rstd"), "n_back")


@query("W17_observed_or_predicted", sql(f" SELECT o.target, {S.format('o.ts')} AS ts, round(CASE WHEN o.ts <= TIMESTAMP '2024-01-20' THEN o.y ELSE s.y END, 6) AS value, CASE WHEN o.ts <= TIMESTAMP '2024-01-20' THEN 'observed' ELSE 'predicted' END AS source FROM obs o LEFT JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 24 HOUR", HOURLY))
def observed_or_predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf)
    predicted = features.seasonal_shift(rows, 24).select("target", "ts", "y_pred")
    return features.observed_or_predicted(rows, predicted, "2024-01-20 00:00:00").select("target", stamp("ts").alias("ts"), r("value").alias("value"), "source")


_BOUNDS = "b AS (SELECT date_trunc('day', min(o_orderdate)) AS first, date_trunc('day', max(o_orderdate)) + INTERVAL 23 HOUR AS last FROM orders)"
_CANDIDATES = f"""WITH {_BOUNDS},
c AS (
  SELECT first AS train_start, make_timestamp(year(first) + 1, 1, 1, 0, 0, 0) - INTERVAL 7 DAY - INTERVAL 1 HOUR AS train_end, 'anchor_new_year' AS scheme, CAST(NULL AS INT) AS extra_days, CAST(NULL AS INT) AS shift_days, 0 AS seq, last FROM b
  UNION ALL SELECT first, first + to_months(CAST(m AS INT)) - INTERVAL 1 HOUR, 'cumulative_months', NULL, NULL, 100 + m, last FROM b, range(1, 13) t(m)
  UNION ALL SELECT first + to_days(CAST(7 * w AS INT)), first + to_days(CAST(7 * w AS INT)) + INTERVAL 1 MONTH - INTERVAL 1 HOUR, 'fixed_1m_step7d', NULL, 7 * w, 1000 + w, last FROM b, range(0, (SELECT CAST(floor(datediff('day', first, last) / 7) AS BIGINT) + 1 FROM b)) t(w)
  UNION ALL SELECT first, first + to_months(CAST(m AS INT)) - INTERVAL 1 HOUR + to_days(CAST(d AS INT)), 'cum_m_plus_days', d, NULL, 100000 + m * 10 + d, last FROM b, range(1, 13) t(m), range(1, 7) u(d)),
n AS (SELECT *, CASE WHEN date_trunc('day', train_end + INTERVAL 7 DAY) = train_end + INTERVAL 7 DAY THEN train_end + INTERVAL 7 DAY ELSE date_trunc('day', train_end + INTERVAL 7 DAY) + INTERVAL 1 DAY END AS test_start FROM c),
s AS (SELECT *, test_start + INTERVAL 23 HOUR AS test_end, row_number() OVER (PARTITION BY train_start, test_start ORDER BY seq) AS k FROM n WHERE test_start <= last AND train_end <= last)"""
_SPLIT_COLUMNS = ", ".join(f"{S.format(c)} AS {c}" for c in ("train_start", "train_end", "test_start", "test_end"))


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The first hour of the first day of orders and the last hour of the last one."""
    first, last = (F.date_trunc("day", f("o_orderdate").cast("timestamp")).cast("timestamp_ntz") for f in (F.min, F.max))
    return tables.table(spark, sf, "orders").agg(first.alias("first"), last.alias("last")).select("first", F.expr("last + interval 23 hours").alias("last"))


@query("G01_rolling_splits", f"{_CANDIDATES} SELECT {_SPLIT_COLUMNS}, scheme, CAST(extra_days AS INT) AS extra_days, CAST(shift_days AS INT) AS shift_days FROM s WHERE k = 1")
def rolling_splits(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.rolling_splits(_bounds(spark, sf))
    return out.select(*[stamp(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")], "scheme", "extra_days", "shift_days")


@query("G02_G05_split_schemes", f"{_CANDIDATES} SELECT scheme, count(*) AS n, strftime(min(test_start), '%Y-%m-%d') AS first_test, strftime(max(test_end), '%Y-%m-%d') AS last_test FROM s WHERE k = 1 GROUP BY 1")
def split_schemes(spark: SparkSession, sf: str) -> DataFrame:
    day = "yyyy-MM-dd"
    return splits.rolling_splits(_bounds(spark, sf)).groupBy("scheme").agg(F.count("*").alias("n"), F.date_format(F.min("test_start"), day).alias("first_test"), F.date_format(F.max("test_end"), day).alias("last_test"))


@query("L02_even_choice", f"{_CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY test_start, seq) - 1 AS i, count(*) OVER () AS n FROM s WHERE k = 1), w AS (SELECT DISTINCT round_even(j * (n - 1) / 11.0, 0) AS i FROM o, range(12) t(j)) SELECT {_SPLIT_COLUMNS}, scheme FROM o SEMI JOIN w USING (i)")
def even_choice(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.pick(splits.rolling_splits(_bounds(spark, sf)), 12, "even")
    return out.select(*[stamp(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")], "scheme")


@query("G06_day_blocks", f"WITH {_BOUNDS} SELECT {S.format('d')} AS day, {S.format('greatest(first, d - INTERVAL 60 DAY)')} AS train_start, {S.format('d - INTERVAL 1 HOUR')} AS train_end FROM b, generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '1995-06-01', INTERVAL 1 DAY) t(d)")
def day_blocks(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.day_blocks(_bounds(spark, sf), "1995-02-01 00:00:00", "1995-06-01 00:00:00", 60)
    return out.select(*[stamp(c).alias(c) for c in ("day", "train_start", "train_end")])


@query("J11_split_members", sql(f""", sp AS (SELECT TIMESTAMP '2024-01-01' AS train_start, TIMESTAMP '2024-01-01' + to_days(CAST(k AS INT)) - INTERVAL 1 HOUR AS train_end, TIMESTAMP '2024-01-01' + to_days(CAST(k + 1 AS INT)) AS test_start, TIMESTAMP '2024-01-01' + to_days(CAST(k + 2 AS INT)) - INTERVAL 1 HOUR AS test_end FROM range(3, 20) t(k))
SELECT {_SPLIT_COLUMNS}, count(*) FILTER (ts BETWEEN train_start AND train_end) AS n_train, count(*) FILTER (ts BETWEEN test_start AND test_end) AS n_test FROM sp JOIN ev ON ev.ts BETWEEN train_start AND test_end GROUP BY ALL""", HOURLY))
def split_members(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(3, 20).select(F.expr("cast(id as int)").alias("k"))
    at = lambda k: F.expr("timestamp_ntz '2024-01-01'") + F.make_dt_interval(k)
    sp = days.select(F.lit("walk").alias("scheme"), at(F.lit(0)).alias("train_start"), (at(F.col("k")) - F.expr("interval 1 hour")).alias("train_end"), at(F.col("k") + 1).alias("test_start"), (at(F.col("k") + 2) - F.expr("interval 1 hour")).alias("test_end"))
    out = splits.members(sp, tables.hourly_sums(tables.table(spark, sf, "events")))
    return out.select(*[stamp(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")], "n_train", "n_test")

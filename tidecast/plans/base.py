"""What the queries start from, in Spark and as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import forecast
from tidecast.plans.registry import OFF_HALF
from tidecast.sources import tables

#: Calibration and evaluation days.
CALIBRATION, EVALUATION = ("2024-01-08", "2024-01-19"), ("2024-01-20", "2024-01-30")

HOURLY = """
ev AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS p, sum(CASE WHEN event_type IN ('click', 'view') THEN value END) AS q FROM events GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(ts) FROM ev), (SELECT max(ts) FROM ev), INTERVAL 1 HOUR)) AS ts),
hourly AS (SELECT g.ts, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM grid g LEFT JOIN ev USING (ts)),
obs AS (SELECT 'P' AS target, ts, p AS y FROM hourly UNION ALL SELECT 'Q', ts, q FROM hourly)"""

FACTS = HOURLY + """,
raw AS (
  SELECT 'naive24' AS model_id, o.target, o.ts, o.y, s.y AS y_pred FROM obs o JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 24 HOUR
  UNION ALL SELECT 'dup_naive24', o.target, o.ts, o.y, s.y FROM obs o JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 24 HOUR
  UNION ALL SELECT 'naive168', o.target, o.ts, o.y, s.y FROM obs o JOIN obs s ON s.target = o.target AND s.ts = o.ts - INTERVAL 168 HOUR
  UNION ALL SELECT 'mean24', o.target, o.ts, o.y, d.m FROM obs o JOIN (SELECT target, CAST(ts AS DATE) AS d, avg(y) AS m FROM obs GROUP BY 1, 2) d ON d.target = o.target AND d.d = CAST(o.ts AS DATE) - 1
  UNION ALL SELECT 'hourmean7d', o.target, o.ts, o.y, m.m FROM obs o JOIN (SELECT a.target, a.ts, avg(b.y) AS m, count(*) AS n FROM obs a JOIN obs b ON b.target = a.target AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 168 HOUR AND hour(b.ts) = hour(a.ts) GROUP BY 1, 2) m ON m.target = o.target AND m.ts = o.ts AND m.n = 7),
allfacts AS (SELECT model_id, target, ts, CAST(ts AS DATE) AS date, hour(ts) + 1 AS horizon, y AS y_true, y_pred, y - y_pred AS error FROM raw WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-31'),
cal AS (SELECT * FROM allfacts WHERE date <= DATE '2024-01-19'),
facts AS (SELECT * FROM allfacts WHERE date >= DATE '2024-01-20')"""


def sql(body: str, start: str = FACTS) -> str:
    """A query over the common expressions; body may add more, beginning with a comma, before its SELECT."""
    return f"WITH {start.strip()}{body}"


def r(column: Column | str, places: int = 6) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(OFF_HALF), places)


def stamp(column: str) -> Column:
    return F.date_format(column, tables.STAMP)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hourly_pair(spark, sf_dir)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.observations(hourly(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str, period: tuple[str, str] = EVALUATION) -> DataFrame:
    return forecast.all_models(obs(spark, sf_dir), *period)

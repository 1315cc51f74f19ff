"""Queries of the search over parameters: proposals, unique trials, objectives, pruning, resuming, features, preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import features, tuning
from tidecast.plans.base import HOURLY, obs, r, sql
from tidecast.plans.registry import query
from tidecast.sources import tables

RUN, TRIALS, BUDGET, STARTUP = "blend", 40, 25, 8
SPACE = {"weight": (0.0, 1.0, 1), "shift": (-20.0, 20.0, -1)}


def _draw(name: str) -> str:
    low, high, places = SPACE[name]
    return f"round({low!r} + {high - low!r} * (('0x' || substr(sha256('{RUN}|' || trial || '|{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE), {places}) + 0.0::DOUBLE"


_PROPOSED = f" , tr AS (SELECT CAST(trial AS INT) AS trial, {_draw('weight')} AS weight, {_draw('shift')} AS shift FROM range(1, {TRIALS + 1}) t(trial))"
_UNIQUE = _PROPOSED + f""", hs AS (SELECT *, sha256(printf('%.6f', shift) || '|' || printf('%.6f', weight)) AS parameter_hash FROM tr), du AS (SELECT *, min(trial) OVER (PARTITION BY parameter_hash) AS first FROM hs),
un AS (SELECT trial, weight, shift, parameter_hash, CASE WHEN first < trial THEN first END AS duplicate_of, first = trial AND sum(CASE WHEN first = trial THEN 1 ELSE 0 END) OVER (ORDER BY trial) <= {BUDGET} AS terminal FROM du)"""
_FOLD_ROWS = """, fr AS (SELECT o.ts, CAST((date_diff('day', DATE '2024-01-08', CAST(o.ts AS DATE))) // 4 AS INT) AS fold, o.y, a.y AS a, b.y AS b FROM obs o JOIN obs a ON a.target = o.target AND a.ts = o.ts - INTERVAL 24 HOUR JOIN obs b ON b.target = o.target AND b.ts = o.ts - INTERVAL 168 HOUR WHERE o.target = 'P' AND o.ts >= TIMESTAMP '2024-01-08' AND o.ts < TIMESTAMP '2024-01-28')"""
_OBJECTIVES = _UNIQUE + _FOLD_ROWS + ", ob AS (SELECT trial, fold, count(*) AS n, sqrt(avg(pow(y - (weight * a + (1 - weight) * b + shift), 2))) AS rmse FROM fr, un WHERE terminal GROUP BY 1, 2)"
_PRUNED = _OBJECTIVES + f""", so AS (SELECT *, avg(rmse) OVER (PARTITION BY trial ORDER BY fold) AS so_far FROM ob), md AS (SELECT fold, quantile_cont(so_far, 0.5) AS median FROM so WHERE trial <= {STARTUP} GROUP BY 1),
sp AS (SELECT trial, min(CASE WHEN trial > {STARTUP} AND so_far > median THEN fold END) AS stop, max(fold) AS last FROM so JOIN md USING (fold) GROUP BY 1),
pr AS (SELECT so.trial, count(*) AS folds_completed, CASE WHEN max(stop) IS NULL THEN 'COMPLETE' ELSE 'PRUNED' END AS state, CASE WHEN max(stop) IS NULL THEN max_by(so_far, fold) END AS objective FROM so JOIN sp USING (trial) WHERE fold <= coalesce(stop, last) GROUP BY 1)"""


def unique(spark: SparkSession) -> DataFrame:
    return tuning.unique_trials(tuning.proposals(spark, RUN, TRIALS, SPACE), list(SPACE), BUDGET)


def fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(ts, fold, y, a, b): P with the values of a day and of a week before, in folds of four days."""
    rows = obs(spark, sf).where("target = 'P'")
    week = features.seasonal_shift(rows, 168, name="b").drop("y")
    inside = features.seasonal_shift(rows, 24, name="a").join(week, ["target", "ts"])
    inside = inside.where("ts >= timestamp_ntz '2024-01-08 00:00:00' and ts < timestamp_ntz '2024-01-28 00:00:00'")
    return inside.withColumn("fold", F.expr("cast(datediff(to_date(ts), date '2024-01-08') div 4 as int)"))


def objectives(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.blend_objectives(fold_rows(spark, sf), unique(spark).where("terminal"))


@query("M10_proposals", sql(_PROPOSED + " SELECT * FROM tr", HOURLY))
def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.proposals(spark, RUN, TRIALS, SPACE)


@query("M19_unique_trials", sql(_UNIQUE + " SELECT * FROM un", HOURLY))
def unique_trials(spark: SparkSession, sf: str) -> DataFrame:
    return unique(spark)


@query("M06_fold_objectives", sql(_OBJECTIVES + " SELECT trial, fold, n, round(rmse, 6) AS rmse FROM ob", HOURLY))
def fold_objectives(spark: SparkSession, sf: str) -> DataFrame:
    return objectives(spark, sf).withColumn("rmse", r("rmse"))


@query("M08_pruned_trials", sql(_PRUNED + " SELECT trial, folds_completed, state, round(objective, 6) AS objective FROM pr", HOURLY))
def pruned_trials(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.pruned(objectives(spark, sf), STARTUP).withColumn("objective", r("objective"))


@query("M11_best_trial", sql(_PRUNED + " SELECT trial, weight, shift, round(objective, 6) AS objective FROM pr JOIN un USING (trial) WHERE state = 'COMPLETE' ORDER BY round(objective, 9), trial LIMIT 1", HOURLY))
def best_trial(spark: SparkSession, sf: str) -> DataFrame:
    found = tuning.pruned(objectives(spark, sf), STARTUP).where("state = 'COMPLETE'").join(unique(spark), "trial")
    return found.orderBy(F.round("objective", 9), "trial").limit(1).select("trial", "weight", "shift", r("objective").alias("objective"))


@query("M18_pending_trials", sql(_PRUNED + ", dn AS (SELECT parameter_hash FROM pr JOIN un USING (trial) WHERE trial <= 20) SELECT trial, weight, shift FROM un WHERE terminal AND parameter_hash NOT IN (SELECT parameter_hash FROM dn)", HOURLY))
def pending_trials(spark: SparkSession, sf: str) -> DataFrame:
    trials = unique(spark)
    done = tuning.pruned(objectives(spark, sf), STARTUP).where("trial <= 20").join(trials, "trial")
    return tuning.pending(trials.where("terminal"), done).select("trial", "weight", "shift")


_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]


@query("M03_chosen_features", f"WITH c AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, coalesce(abs(corr({c}, l_extendedprice)), 0) AS score FROM lineitem''' for c in _COLUMNS)}), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, feature) AS rank FROM c) SELECT feature, round(score, 6) AS score, CAST(rank AS INT) AS rank, rank <= 4 AS chosen FROM k")
def chosen_features(spark: SparkSession, sf: str) -> DataFrame:
    out = tuning.ranked_features(tables.table(spark, sf, "lineitem"), _COLUMNS, "l_extendedprice")
    return out.withColumn("score", r("score"))


@query("M02_prepared_rows", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_returnflag, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM lineitem),
t AS (SELECT * FROM s WHERE early AND l_returnflag <> 'N'), c AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM t))
SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum(quantity), 3) AS quantity FROM (SELECT l_linenumber, coalesce(code, -1) AS l_returnflag, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS quantity FROM s LEFT JOIN c USING (l_returnflag)) GROUP BY 1, 2""")
def prepared_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    train = rows.where("l_shipdate < timestamp '1998-01-01' and l_returnflag <> 'N'")
    out = tuning.prepared(train, rows, ["l_quantity"], ["l_returnflag"])
    return out.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 3).alias("quantity"))

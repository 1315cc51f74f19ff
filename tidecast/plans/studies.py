"""Queries of labels, guards, study summaries and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.operators import audit, compare, features, guards, metrics, naming, planner, search, splits
from tidecast.plans.audits import _CANDIDATES, _SPLIT_COLUMNS, _bounds
from tidecast.plans.base import HOURLY, facts, hourly, obs, r, sql, stamp
from tidecast.plans.comparison import _LOSSES, hourly_losses
from tidecast.plans.evaluation import POINT, D, S, day
from tidecast.plans.registry import OFF_HALF, query
from tidecast.plans.search import _TRIALS, trials
from tidecast.sources import tables


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        return f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows) + ")"


_SPELLINGS = [("p",), ("P_Power",), ("Q",), ("q_POWER",), ("R_Power",), (None,)]


@query("P17_canonical_targets", f"SELECT name, CASE WHEN lower(name) IN ('p', 'p_power') THEN 'P_Power' WHEN lower(name) IN ('q', 'q_power') THEN 'Q_Power' END AS target FROM {_values(_SPELLINGS)} v(name)")
def canonical_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_SPELLINGS, "name string")
    return rows.select("name", naming.canonical_target(F.col("name")).alias("target"))


_RUNS = [(label, selector, shared, policy) for label in (None, "mine") for selector in (None, "all", "mi_top_k", "sfs_forward") for shared in (None, True, False) for policy in (None, "mutual", "own", "drop")]


@query("P25_run_labels", f"""SELECT run_label, selector, shared, policy, CASE WHEN coalesce(run_label, '') <> '' THEN run_label WHEN coalesce(selector, 'all') LIKE 'sfs%' THEN CASE WHEN coalesce(shared, true) THEN 'SFS_shared' ELSE 'SFS' END
WHEN coalesce(selector, 'all') = 'mi_top_k' THEN CASE WHEN coalesce(policy, 'mutual') = 'drop' THEN 'mi_top_k_nolags' ELSE 'mi_top_k' END WHEN coalesce(policy, 'mutual') = 'drop' THEN 'LagDrop' WHEN coalesce(policy, 'mutual') = 'own' THEN 'own_lags' WHEN coalesce(shared, true) THEN 'Shared_mutual_lags' ELSE 'mutual_lags' END AS family FROM {_values(_RUNS)} v(run_label, selector, shared, policy)""")
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_RUNS, "run_label string, selector string, shared boolean, policy string")
    return rows.withColumn("family", naming.run_label(*[F.col(c) for c in ("run_label", "selector", "shared", "policy")]))


_TOKENS = [("LagDrop",), ("mi_top_k_nolags",), ("no_lags_x",), ("own",), ("own_lags",), ("Shared_Mutual_lags",), ("",), (None,)]


@query("P26_lag_policies", f"SELECT token, CASE WHEN lower(token) LIKE '%lagdrop%' OR lower(token) LIKE '%nolags%' OR contains(lower(token), 'no_lags') THEN 'drop' WHEN lower(token) = 'own' THEN 'own' WHEN lower(token) LIKE '%mutual%' THEN 'mutual' END AS policy FROM {_values(_TOKENS)} v(token)")
def lag_policies(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_TOKENS, "token string")
    return rows.select("token", naming.lag_policy(F.col("token")).alias("policy"))


_SYSTEMS = [(f, k, p) for f, p in (("mutual_lags", "mutual"), ("Shared_mutual_lags", "mutual"), ("own_lags", "own"), ("LagDrop", "drop"), ("mi_top_k_nolags", "drop"), ("SFS_shared", "mutual"), ("SFS", "mutual"), ("baseline", "naive 24 h"), ("baseline", "168"), ("new_family", None)) for k in (0, 1, 2, 5)]


def _sheet(table: dict[int, str], other: str) -> str:
    return "CASE sheet " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


@query("P12_publication_labels", f"""WITH s AS (SELECT *, lower(family) AS f, {_sheet(naming.SHEET_CODES, "'L' || sheet")} AS code, {_sheet(naming.SHEET_LAGS, "'preparation sheet ' || sheet")} AS lags, {_sheet(naming.SHEET_MATRICES, "'sheet-' || sheet")} AS matrix, CAST(coalesce(nullif(regexp_extract(coalesce(lag_policy, ''), '([0-9]+)', 1), ''), CAST(sheet AS VARCHAR)) AS INT) AS lag FROM {_values(_SYSTEMS)} v(family, sheet, lag_policy)),
n AS (SELECT *, CASE WHEN f IN ('mutual_lags', 'shared_mutual_lags') THEN 'MUT-' || code WHEN f = 'own_lags' THEN 'OWN-' || code {' '.join(f"WHEN f = '{k}' THEN '{v[0]}'" for k, v in naming.LABELS.items())} WHEN f = 'sfs' THEN 'SFS-' || code || '-prep' {' '.join(f"WHEN f = 'baseline' AND lag = {k} THEN '{v[0]}'" for k, v in naming.NAIVE.items())} ELSE family || '-' || sheet END AS short FROM s)
SELECT family, sheet, lag_policy, short, CASE WHEN f IN ('mutual_lags', 'shared_mutual_lags') THEN 'Mutual history, ' || lags || ' (' || short || ')' WHEN f = 'own_lags' THEN 'Own history, ' || lags || ' (' || short || ')' {' '.join(f"WHEN f = '{k}' THEN '{v[1]}'" for k, v in naming.LABELS.items())} WHEN f = 'sfs' THEN 'SFS, ' || matrix || ' preparation matrix (' || short || ')' {' '.join(f"WHEN f = 'baseline' AND lag = {k} THEN '{v[1]}'" for k, v in naming.NAIVE.items())} ELSE short END AS long,
CASE WHEN f IN ('mutual_lags', 'shared_mutual_lags') THEN 'Mutual history' WHEN f = 'own_lags' THEN 'Own history' {' '.join(f"WHEN f = '{k}' THEN '{v[2]}'" for k, v in naming.LABELS.items())} WHEN f = 'sfs' THEN 'SFS' WHEN f = 'baseline' AND lag IN (24, 168) THEN 'Seasonal naive' ELSE replace(family, '_', ' ') END AS "group" FROM n""")
def publication_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_SYSTEMS, "family string, sheet int, lag_policy string")
    return naming.publication_labels(rows, planner.clean_name(F.concat_ws("-", "family", F.col("sheet").cast("string"))))


@query("P22_manuscript_rounding", sql(f" , s AS (SELECT target, avg(abs(error)) AS scale FROM facts WHERE model_id = 'naive24' GROUP BY 1), m AS (SELECT model_id, target, {', '.join(f'{POINT[k]} AS {k}' for k in ('rmse', 'mae', 'wmape'))} FROM facts GROUP BY 1, 2) SELECT model_id, target, {', '.join(f'round({k} + {OFF_HALF!r}, 2) AS {k}' for k in ('rmse', 'mae', 'wmape'))}, round(mae / scale, 3) AS mase FROM m JOIN s USING (target)"))
def manuscript_rounding(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.summarise(facts(spark, sf), ["model_id", "target"], ["rmse", "mae", "wmape"])
    scale = rows.where("model_id = 'naive24'").select("target", F.col("mae").alias("scale"))
    rows = rows.join(F.broadcast(scale), "target").withColumn("mase", F.col("mae") / F.col("scale"))
    return rows.select("model_id", "target", *[r(c, naming.PLACES[c]).alias(c) for c in ("rmse", "mae", "wmape")], r("mase", naming.PLACES["mase"]).alias("mase"))


@query("P08_duplicate_columns", sql(f" SELECT {S.format('ts')} AS ts, round(p, 6) AS p, round(q, 6) AS q, CAST(hour(ts) AS INT) AS hour FROM hourly", HOURLY))
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    pair = hourly(spark, sf)
    left, right = pair.select("ts", "p", F.hour("ts").alias("hour")), pair.select("ts", "q", F.hour("ts").alias("hour"))
    both = features.first_of_each_column(left, right, "ts")
    return both.select(stamp("ts").alias("ts"), r("p").alias("p"), r("q").alias("q"), "hour")


_ARTIFACTS = [
    ("a", "P_Power", "mutual", ["P_Power_lag_24", "P_Power_lag_1", "Temperature", "Q_Power_rmean_24"], ["P_Power_lag_1", "Q_Power_rmean_24"]),
    ("a", "Q_Power", "own", ["Q_Power_lag_24", "P_Power_lag_24"], []),
    ("b", "P_Power", "drop", ["Temperature", "P_Power_lag_168"], None),
    ("b", "Q_Power", "mutual", ["Q_Power_lag_1", "Q_Power_rstd_24", "Q_Power", "unknown"], ["Temperature", "hour_sin"]),
    ("c", "P_Power", "mutual", ["hour_sin", "Temperature"], ["hour_sin"]),
]
_OFFERED = ["P_Power", "Q_Power", "P_Power_lag_1", "P_Power_lag_24", "P_Power_lag_168", "Q_Power_lag_1", "Q_Power_lag_24", "Q_Power_rmean_24", "Q_Power_rstd_24", "Temperature", "hour_sin"]


@query("F10_leaks", f"""WITH a AS (SELECT * FROM {_values(_ARTIFACTS)} v(model_id, target, lag_policy, features, recalc)), u AS (SELECT model_id, target, lag_policy, features, coalesce(recalc, []::VARCHAR[]) AS recalc, unnest(list_distinct(list_concat(features, coalesce(recalc, []::VARCHAR[])))) AS feature FROM a),
k AS (SELECT *, list_contains(features, feature) AS listed, list_contains(recalc, feature) AS again, nullif(regexp_extract(feature, '^(P_Power|Q_Power)_(lag|rmean|rstd)_([0-9]+)$', 1), '') AS owner, regexp_extract(feature, '^(P_Power|Q_Power)_(lag|rmean|rstd)_([0-9]+)$', 2) AS kind, TRY_CAST(regexp_extract(feature, '^(P_Power|Q_Power)_(lag|rmean|rstd)_([0-9]+)$', 3) AS INT) AS hours FROM u),
z AS (SELECT *, CASE WHEN again AND NOT listed THEN 'recalculated but not a feature' WHEN feature IN ('P_Power', 'Q_Power') THEN 'a raw target' WHEN feature NOT IN ({', '.join(repr(f) for f in _OFFERED)}) THEN 'not a column' WHEN again AND owner IS NULL THEN 'recalculated but not dynamic' WHEN owner IS NOT NULL AND lag_policy = 'drop' THEN 'dynamic under the policy drop' WHEN owner <> target AND lag_policy = 'own' THEN 'another target under the policy own' WHEN kind IN ('rmean', 'rstd') AND NOT again THEN 'a rolling statistic that is not recalculated' WHEN kind = 'lag' AND hours < 24 AND NOT again THEN 'a short lag that is not recalculated' END AS fault FROM k)
SELECT model_id, target, feature, fault FROM z WHERE fault IS NOT NULL""")
def leaks(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = spark.createDataFrame(_ARTIFACTS, "model_id string, target string, lag_policy string, features array<string>, recalc_features array<string>")
    return guards.leaks(artifacts, spark.createDataFrame([(f,) for f in _OFFERED], "feature string"), 24)


@query("F18_origin_counts", sql(" SELECT model_id, count(DISTINCT date) AS origins, count(DISTINCT date) = 11 AS complete FROM facts GROUP BY 1"))
def origin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return guards.origin_counts(metrics.daily_losses(facts(spark, sf)), 11)


@query("F24_one_vector", "WITH a AS (SELECT s_nationkey AS anchor, CASE WHEN s_suppkey % 2 = 0 THEN 'P' ELSE 'Q' END AS target, s_nationkey % 3 AS depth, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE s_suppkey % 2 END AS rate FROM supplier) SELECT anchor, count(DISTINCT target) AS targets, count(DISTINCT (depth, rate)) AS vectors, count(DISTINCT target) = 2 AND count(DISTINCT (depth, rate)) = 1 AS consistent FROM a GROUP BY 1")
def one_vector(spark: SparkSession, sf: str) -> DataFrame:
    nation, number = F.col("s_nationkey"), F.col("s_suppkey")
    rate = F.when(nation % 2 == 0, 1).otherwise(number % 2)
    rows = tables.table(spark, sf, "supplier").select(nation.alias("anchor"), F.when(number % 2 == 0, "P").otherwise("Q").alias("target"), (nation % 3).alias("depth"), rate.alias("rate"))
    return guards.one_vector(rows, "anchor", ["depth", "rate"])


@query("J09_stored_mase", sql(f" , st AS (SELECT date, avg(abs(error)) / 100 AS stored FROM facts WHERE model_id = 'naive24' AND target = 'P' AND isodow(date) <= 5 GROUP BY 1) SELECT model_id, target, strftime(f.date, '%Y-%m-%d') AS date, round(max(stored), 6) AS stored, max(stored) IS NULL AS missing FROM facts f LEFT JOIN st USING (date) GROUP BY model_id, target, f.date"))
def stored_mase(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    stored = rows.where("model_id = 'naive24' and target = 'P' and weekday(date) < 5").groupBy("date").agg((F.avg(F.abs("error")) / 100).alias("stored"))
    days = rows.select("model_id", "target", "date").distinct().join(F.broadcast(stored), "date", "left")
    return days.select("model_id", "target", day(), r("stored").alias("stored"), F.col("stored").isNull().alias("missing"))


@query("J14_audit_join", sql(" , e AS (SELECT model_id, target, date, count(*) AS n FROM facts GROUP BY 1, 2, 3), st AS (SELECT model_id, target, count(*) AS origins, count(*) FILTER (n <> 24) AS faulty FROM e GROUP BY 1, 2), be AS (SELECT model_id, target, count(*) AS changed FROM facts WHERE model_id <> 'mean24' AND abs(error) > 100 GROUP BY 1, 2) SELECT st.model_id, st.target, origins, faulty, coalesce(changed, 0) AS changed FROM st LEFT JOIN be USING (model_id, target)"))
def audit_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    behaviour = rows.where("model_id <> 'mean24' and abs(error) > 100").groupBy("model_id", "target").agg(F.count("*").alias("changed"))
    return audit.trajectory_faults(rows).join(behaviour, ["model_id", "target"], "left").select("model_id", "target", "origins", "faulty", F.coalesce("changed", F.lit(0)).alias("changed"))


@query("J15_point_and_probabilistic", sql(_LOSSES + f" , pt AS (SELECT model_id, target, {POINT['rmse']} AS rmse FROM facts GROUP BY 1, 2), pl AS (SELECT model_id, target, avg(crps) AS crps, avg(pb) AS pb FROM hl GROUP BY 1, 2) SELECT model_id, target, round(rmse, 6) AS rmse, round(crps, 6) AS crps, round(pb, 6) AS pb FROM pt JOIN pl USING (model_id, target)"))
def point_and_probabilistic(spark: SparkSession, sf: str) -> DataFrame:
    key = ["model_id", "target"]
    losses = hourly_losses(spark, sf).groupBy(*key).agg(F.avg("crps").alias("crps"), F.avg("pb").alias("pb"))
    out = guards.one_to_one(metrics.summarise(facts(spark, sf), key, ["rmse"]), losses, key)
    return out.select(*key, *[r(c).alias(c) for c in ("rmse", "crps", "pb")])


_FIXED = {"P": 250.0, "Q": 100.0}


@query("A16_point_summary", sql(f" , m AS (SELECT model_id, target, count(DISTINCT date) AS d, count(*) AS h, {POINT['rmse']} AS rmse, {POINT['mae']} AS mae FROM facts GROUP BY 1, 2) SELECT model_id, max(CASE WHEN target = 'P' THEN d END) AS n_origins, max(CASE WHEN target = 'P' THEN h END) AS n_hours, {', '.join(f'''round(max(CASE WHEN target = '{t}' THEN {v} END), 6) AS {t.lower()}_{v}''' for t in 'PQ' for v in ('rmse', 'mae'))}, round(0.5 * (max(CASE WHEN target = 'P' THEN rmse END) / {_FIXED['P']} + max(CASE WHEN target = 'Q' THEN rmse END) / {_FIXED['Q']}), 6) AS paired FROM m GROUP BY 1"))
def point_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    got = metrics.summarise(rows, ["model_id", "target"], ["n", "rmse", "mae"]).join(rows.groupBy("model_id", "target").agg(F.count_distinct("date").alias("d")), ["model_id", "target"])
    of = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    wide = got.groupBy("model_id").agg(of("P", "d").alias("n_origins"), of("P", "n").alias("n_hours"), *[of(t, v).alias(f"{t.lower()}_{v}") for t in "PQ" for v in ("rmse", "mae")])
    paired = 0.5 * (F.col("p_rmse") / _FIXED["P"] + F.col("q_rmse") / _FIXED["Q"])
    return wide.select("model_id", "n_origins", "n_hours", *[r(c).alias(c) for c in ("p_rmse", "p_mae", "q_rmse", "q_mae")], r(paired).alias("paired"))


@query("A16_daily_wide", sql(f" , m AS (SELECT model_id, date, target, avg(error * error) AS mse, avg(abs(error)) AS mae FROM facts GROUP BY 1, 2, 3), w AS (SELECT model_id, date, {', '.join(f'''max(CASE WHEN target = '{t}' THEN {v} END) AS {v}_{t.lower()}''' for v in ('mse', 'mae') for t in 'PQ')} FROM m GROUP BY 1, 2) SELECT model_id, {D}, round(mse_p, 3) AS mse_p, round(mse_q, 3) AS mse_q, round(mae_p, 6) AS mae_p, round(mae_q, 6) AS mae_q, round(0.5 * (mse_p / {_FIXED['P']**2} + mse_q / {_FIXED['Q']**2}), 6) AS paired FROM w"))
def daily_wide(spark: SparkSession, sf: str) -> DataFrame:
    daily = metrics.daily_losses(facts(spark, sf))
    wide = daily.groupBy("model_id", "date").pivot("target", ["P", "Q"]).agg(F.max("se").alias("mse"), F.max("ae").alias("mae"))
    paired = 0.5 * (F.col("P_mse") / _FIXED["P"] ** 2 + F.col("Q_mse") / _FIXED["Q"] ** 2)
    return wide.select("model_id", day(), *[r(f"{t}_mse", 3).alias(f"mse_{t.lower()}") for t in "PQ"], *[r(f"{t}_mae").alias(f"mae_{t.lower()}") for t in "PQ"], r(paired).alias("paired"))


_CYCLES = _TRIALS + ", c AS (SELECT run_id, CAST((trial - 1) // 500 + 1 AS INT) AS cycle, CAST(sum(CASE WHEN state = 'COMPLETE' THEN fits END) AS BIGINT) AS candidate_fits, CAST(sum(CASE WHEN state = 'PRUNED' THEN fits END) AS BIGINT) AS peer_fits, sum(seconds) AS seconds, min(CASE WHEN state = 'COMPLETE' THEN objective END) AS objective FROM t GROUP BY 1, 2)"


@query("A29_cycle_costs", _CYCLES + " SELECT run_id, cycle, coalesce(candidate_fits, 0) AS candidate_fits, coalesce(peer_fits, 0) AS peer_fits, coalesce(candidate_fits, 0) + coalesce(peer_fits, 0) AS total_fits, round(seconds, 3) AS seconds, CAST(sum(coalesce(candidate_fits, 0) + coalesce(peer_fits, 0)) OVER w AS BIGINT) AS fits_so_far, round(sum(seconds) OVER w, 3) AS seconds_so_far, round(objective, 6) AS objective FROM c WINDOW w AS (PARTITION BY run_id ORDER BY cycle)")
def cycle_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = trials(spark, sf).withColumn("cycle", F.expr("cast((trial - 1) div 500 + 1 as int)"))
    out = search.cycle_costs(rows, "run_id")
    return out.select("run_id", "cycle", "candidate_fits", "peer_fits", "total_fits", r("seconds", 3).alias("seconds"), "fits_so_far", r("seconds_so_far", 3).alias("seconds_so_far"), r("objective").alias("objective"))


_MILESTONES = (10, 30, 60)


@query("A30_search_design", _TRIALS + f", p AS (SELECT run_id, trial, min(CASE WHEN state = 'COMPLETE' THEN objective END) OVER w AS best, CAST(sum(fits) OVER w AS BIGINT) AS total_fits, sum(seconds) OVER w AS total_seconds FROM t WINDOW w AS (PARTITION BY run_id ORDER BY trial)), a AS (SELECT run_id, best AS anchor FROM p WHERE trial = {_MILESTONES[0]}) SELECT run_id, CAST(trial AS INT) AS trials, total_fits, round(total_seconds, 3) AS total_seconds, round(best, 6) AS best, round(100 * (best - anchor) / nullif(anchor, 0), 6) AS percent_of_anchor FROM p JOIN a USING (run_id) WHERE trial IN {_MILESTONES}")
def search_design(spark: SparkSession, sf: str) -> DataFrame:
    out = search.milestones(trials(spark, sf), _MILESTONES)
    return out.select("run_id", F.col("trial").alias("trials"), "total_fits", r("total_seconds", 3).alias("total_seconds"), r("best_so_far").alias("best"), r("percent_of_anchor").alias("percent_of_anchor"))


@query("A31_search_tables", _TRIALS + ", s AS (SELECT run_id, count(*) AS terminal, count(*) FILTER (state = 'COMPLETE') AS complete, min(CASE WHEN state = 'COMPLETE' THEN objective END) AS best, min_by(CAST(trial AS INT), (objective, trial)) FILTER (state = 'COMPLETE') AS best_trial FROM t GROUP BY 1) SELECT run_id, terminal, complete, round(best, 6) AS best, best_trial, round(100 * (best / min(best) OVER () - 1), 6) AS percent_over_best, CAST(rank() OVER (ORDER BY round(best, 9)) AS INT) AS place FROM s")
def search_tables(spark: SparkSession, sf: str) -> DataFrame:
    out = search.run_table(trials(spark, sf))
    return out.select("run_id", "terminal", "complete", r("best").alias("best"), "best_trial", r("percent_over_best").alias("percent_over_best"), "place")


@query("A34_milestone_summary", "SELECT event_id AS artifact, coalesce(json_extract_string(props, '$.strategy'), 'shared') AS strategy, CAST(json_extract(props, '$.k') AS INT) AS terminal_milestone, json_extract_string(props, '$.design') AS design FROM events WHERE event_type = 'purchase'")
def milestone_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "events").where("event_type = 'purchase'")
    rows = rows.withColumn("source", F.from_json("props", "k int, strategy string, design string"))
    return rows.select(F.col("event_id").alias("artifact"), F.coalesce("source.strategy", F.lit("shared")).alias("strategy"), F.col("source.k").alias("terminal_milestone"), F.col("source.design").alias("design"))


_PREFERRED = ["mean24", "absent", "naive24"]


@query("L04_horizon_systems", sql(f" , m AS (SELECT model_id, rank() OVER (ORDER BY round(sqrt(avg(error * error)), 9)) AS k FROM facts WHERE target = 'P' GROUP BY 1), o AS (SELECT model_id, row_number() OVER (ORDER BY CASE WHEN list_position({_PREFERRED}, model_id) > 0 THEN list_position({_PREFERRED}, model_id) ELSE 4 END, k, model_id) AS place FROM m) SELECT model_id, CAST(place AS INT) AS place FROM o WHERE place <= 4"))
def horizon_systems(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.summarise(facts(spark, sf).where("target = 'P'"), ["model_id"], ["rmse"])
    ranked = rows.select("model_id", F.rank().over(W.orderBy(F.round("rmse", 9))).alias("rank"))
    return compare.preferred_systems(ranked, _PREFERRED, 4)


_SHEETS = {0: [1], 1: [1, 24], 2: [1, 24, 168]}
_NEEDS = [("short", ["lag_1"]), ("daily", ["lag_1", "lag_24"]), ("weekly", ["lag_168"]), ("other", ["temperature"])]


@query("L07_best_sheets", sql(f" , l AS (SELECT ts, {', '.join(f'lag(y, {k}) OVER (ORDER BY ts) AS lag_{k}' for k in (1, 24, 168))} FROM obs WHERE target = 'P'), t AS (SELECT * FROM l WHERE ts < TIMESTAMP '2024-01-20'), s AS ({' UNION ALL '.join(f'''SELECT {k} AS sheet, {[f'lag_{x}' for x in lags]}::VARCHAR[] AS cols, (SELECT count(*) FROM t WHERE lag_{max(lags)} IS NOT NULL) AS train_rows''' for k, lags in _SHEETS.items())}), n AS (SELECT * FROM {_values(_NEEDS)} v(model_id, needed)), c AS (SELECT n.model_id, s.sheet, s.train_rows, row_number() OVER (PARTITION BY n.model_id ORDER BY s.train_rows DESC NULLS LAST, s.sheet) AS k FROM n LEFT JOIN s ON list_has_all(s.cols, n.needed) AND train_rows > 0) SELECT model_id, sheet, train_rows FROM c WHERE k = 1", HOURLY))
def best_sheets(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.lag_features(obs(spark, sf).where("target = 'P'"), [1, 24, 168]).where("ts < timestamp_ntz '2024-01-20 00:00:00'")
    counts = rows.agg(*[F.count(f"lag_{max(lags)}").alias(f"s{k}") for k, lags in _SHEETS.items()])
    each = F.array(*[F.struct(F.lit(k).alias("sheet"), F.array(*[F.lit(f"lag_{x}") for x in lags]).alias("columns"), F.col(f"s{k}").alias("train_rows")) for k, lags in _SHEETS.items()])
    return compare.best_sheets(spark.createDataFrame(_NEEDS, "model_id string, needed array<string>"), counts.select(F.explode(each).alias("r")).select("r.*"))


@query("G09_refit_bounds", f"{_CANDIDATES}, v AS (SELECT * FROM s WHERE k = 1), e AS (SELECT min(train_start) AS a, max(train_end) AS tr, max(test_end) AS te FROM v), rb AS (SELECT 'through_split_year_end' AS policy, a AS fit_start, make_timestamp(year(te), 12, 31, 23, 0, 0) AS fit_end FROM e UNION ALL SELECT 'through_last_test_end', a, te FROM e UNION ALL SELECT 'through_last_train_end', a, tr FROM e UNION ALL SELECT 'last_train_window', (SELECT min(train_start) FROM v, e WHERE train_end = tr), tr FROM e) SELECT policy, {S.format('fit_start')} AS fit_start, {S.format('fit_end')} AS fit_end FROM rb")
def refit_bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.refit_bounds(splits.rolling_splits(_bounds(spark, sf)))
    return out.select("policy", stamp("fit_start").alias("fit_start"), stamp("fit_end").alias("fit_end"))


@query("L02_stratified_choice", f"""{_CANDIDATES}, v AS (SELECT *, dense_rank() OVER (ORDER BY scheme) - 1 AS g, row_number() OVER (PARTITION BY scheme ORDER BY test_start, seq) - 1 AS i, count(*) OVER (PARTITION BY scheme) AS m FROM s WHERE k = 1),
q AS (SELECT *, least(m, 30 // (SELECT max(g) + 1 FROM v) + CASE WHEN g < 30 % (SELECT max(g) + 1 FROM v) THEN 1 ELSE 0 END) AS quota FROM v),
cc AS (SELECT *, list_contains(list_transform(range(0, quota), lambda j: CAST(round_even(j * (m - 1) / greatest(quota - 1, 1), 0) AS BIGINT)), i) AS taken FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY taken ORDER BY seq) - 1 AS rest, count(*) OVER (PARTITION BY taken) AS among, least(30 - (SELECT count(*) FILTER (taken) FROM cc), (SELECT count(*) FILTER (NOT taken) FROM cc)) AS need FROM cc)
SELECT {_SPLIT_COLUMNS}, scheme FROM f WHERE taken OR list_contains(list_transform(range(0, need), lambda j: CAST(round_even(j * (among - 1) / greatest(need - 1, 1), 0) AS BIGINT)), rest)""")
def stratified_choice(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.pick(splits.rolling_splits(_bounds(spark, sf)), 30, "stratified")
    return out.select(*[stamp(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")], "scheme")


@query("Q33_sign_adapter", sql(" SELECT model_id, target, count(*) AS n, count(DISTINCT date) AS origins, round(avg(error), 6) AS mean_error, round(avg(y_true), 6) AS mean_actual FROM facts GROUP BY 1, 2"))
def sign_adapter(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf)
    told = rows.select(F.col("model_id").alias("snapshot"), F.concat("target", F.lit("_Power")).alias("target"), F.col("date").alias("origin"), F.col("ts").alias("timestamp"), "horizon", F.col("y_true").alias("actual"), F.col("y_pred").alias("prediction"), (F.col("y_pred") - F.col("y_true")).alias("error"))
    back = compare.from_prediction_minus_actual(told)
    return back.groupBy("model_id", "target").agg(F.count("*").alias("n"), F.count_distinct("date").alias("origins"), r(F.avg("error")).alias("mean_error"), r(F.avg("y_true")).alias("mean_actual"))

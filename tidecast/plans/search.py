"""Queries of the search stage: names, feature catalogues, trials, folds, strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.operators import planner, search
from tidecast.plans.base import r
from tidecast.plans.registry import query
from tidecast.sources import tables

#: Orders play the trials: a run per customer's last digits, a trial per order, its state from the order's status.
_TRIALS = "WITH t AS (SELECT o_custkey % 7 AS run_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS trial, CASE WHEN o_orderstatus = 'O' THEN 'PRUNED' ELSE 'COMPLETE' END AS state, o_totalprice / 1000 AS objective, o_orderkey % 5 + 1 AS fits, o_totalprice / 50 AS seconds FROM orders)"
#: Line items play the folds: stratum by return flag, gap by line number.
_FOLDS = "WITH f AS (SELECT l_suppkey % 9 AS run_id, CASE l_returnflag WHEN 'A' THEN 'regular' WHEN 'N' THEN 'calendar' ELSE 'stress' END AS stratum, (l_linenumber % 4) * 24 AS gap, l_extendedprice / 100 AS value, l_quantity AS weight FROM lineitem)"


def trials(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").withColumn("run_id", F.col("o_custkey") % 7)
    trial = F.row_number().over(W.partitionBy("run_id").orderBy("o_orderkey"))
    state = F.when(F.col("o_orderstatus") == "O", "PRUNED").otherwise("COMPLETE")
    return rows.select("run_id", trial.alias("trial"), state.alias("state"), (F.col("o_totalprice") / 1000).alias("objective"), (F.col("o_orderkey") % 5 + 1).alias("fits"), (F.col("o_totalprice") / 50).alias("seconds"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    stratum = F.when(flag == "A", "regular").when(flag == "N", "calendar").otherwise("stress")
    rows = tables.table(spark, sf, "lineitem")
    return rows.select((F.col("l_suppkey") % 9).alias("run_id"), stratum.alias("stratum"), ((F.col("l_linenumber") % 4) * 24).alias("gap"), (F.col("l_extendedprice") / 100).alias("value"), F.col("l_quantity").alias("weight"))


@query("W10_trial_progress", _TRIALS + " SELECT run_id, CAST(trial AS INT) AS trial, round(min(CASE WHEN state = 'COMPLETE' THEN objective END) OVER w, 6) AS best_so_far, CAST(sum(fits) OVER w AS BIGINT) AS total_fits, round(sum(seconds) OVER w, 4) AS total_seconds FROM t WINDOW w AS (PARTITION BY run_id ORDER BY trial)")
def trial_progress(spark: SparkSession, sf: str) -> DataFrame:
    out = search.progress(trials(spark, sf))
    return out.select("run_id", "trial", r("best_so_far").alias("best_so_far"), "total_fits", F.round("total_seconds", 4).alias("total_seconds"))


@query("A36_trial_costs", _TRIALS + " SELECT run_id, count(*) AS terminal, count(*) FILTER (state = 'COMPLETE') AS complete, count(*) FILTER (state = 'PRUNED') AS pruned, CAST(sum(fits) AS BIGINT) AS fits, round(min(CASE WHEN state = 'COMPLETE' THEN objective END), 6) AS best FROM t GROUP BY 1")
def trial_costs(spark: SparkSession, sf: str) -> DataFrame:
    complete = F.col("state") == "COMPLETE"
    got = trials(spark, sf).groupBy("run_id").agg(F.count("*").alias("terminal"), F.count_if(complete).alias("complete"), F.count_if(F.col("state") == "PRUNED").alias("pruned"), F.sum("fits").alias("fits"), F.min(F.when(complete, F.col("objective"))).alias("best"))
    return got.withColumn("best", r("best"))


@query("L05_best_of_first_trials", _TRIALS + " SELECT run_id, min_by(CAST(trial AS INT), (objective, trial)) AS trial, round(min(objective), 6) AS objective FROM t WHERE trial <= 30 AND state = 'COMPLETE' GROUP BY 1")
def best_of_first_trials(spark: SparkSession, sf: str) -> DataFrame:
    some = trials(spark, sf).where("trial <= 30 and state = 'COMPLETE'")
    return some.groupBy("run_id").agg(F.min_by("trial", F.struct("objective", "trial")).alias("trial"), r(F.min("objective")).alias("objective"))


@query("L08_replay_choice", _TRIALS + ", p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY objective, trial) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM t WHERE state = 'PRUNED') SELECT run_id, CAST(trial AS INT) AS trial FROM p WHERE n <= 12 OR k <= 8")
def replay_choice(spark: SparkSession, sf: str) -> DataFrame:
    pruned = trials(spark, sf).where("state = 'PRUNED'")
    run = W.partitionBy("run_id")
    ranked = pruned.withColumns({"k": F.row_number().over(run.orderBy("objective", "trial")), "n": F.count("*").over(run)})
    return ranked.where("n <= 12 or k <= 8").select("run_id", "trial")


@query("A20_stratified_objective", _FOLDS + ", m AS (SELECT run_id, stratum, avg(value) AS m, CASE stratum WHEN 'regular' THEN 0.5 ELSE 0.25 END AS w FROM f GROUP BY 1, 2) SELECT run_id, round(sum(w * m) / sum(w), 6) AS objective FROM m GROUP BY 1")
def stratified_objective(spark: SparkSession, sf: str) -> DataFrame:
    return search.stratified_objective(folds(spark, sf), ["run_id"]).withColumn("objective", r("objective"))


@query("A21_objective_components", _FOLDS + " SELECT stratum, CAST(gap AS INT) AS gap, round(avg(value), 6) AS mean, count(*) AS n FROM f GROUP BY GROUPING SETS ((stratum), (gap), (stratum, gap))")
def objective_components(spark: SparkSession, sf: str) -> DataFrame:
    return search.components(folds(spark, sf)).select("stratum", F.col("gap").cast("int").alias("gap"), r("mean").alias("mean"), "n")


def _modes(how: str) -> str:
    return _FOLDS + f" SELECT run_id, round({how}, 6) AS objective FROM f GROUP BY 1"


@query("A19_mean_objective", _modes("avg(value)"))
def mean_objective(spark: SparkSession, sf: str) -> DataFrame:
    return search.aggregate_targets(folds(spark, sf), ["run_id"], "value").withColumn("objective", r("objective"))


@query("A19_weighted_objective", _modes("sum(weight * value) / sum(weight)"))
def weighted_objective(spark: SparkSession, sf: str) -> DataFrame:
    return search.aggregate_targets(folds(spark, sf), ["run_id"], "value", "weighted").withColumn("objective", r("objective"))


@query("A19_max_objective", _modes("max(value)"))
def max_objective(spark: SparkSession, sf: str) -> DataFrame:
    return search.aggregate_targets(folds(spark, sf), ["run_id"], "value", "max").withColumn("objective", r("objective"))


@query("A22_iteration_counts", _FOLDS + " SELECT run_id, stratum, round(avg(value), 6) AS mean, CAST(greatest(1, round_even(quantile_cont(weight, 0.5), 0)) AS INT) AS iterations FROM f GROUP BY 1, 2")
def iteration_counts(spark: SparkSession, sf: str) -> DataFrame:
    median = F.greatest(F.lit(1), F.bround(F.percentile("weight", 0.5), 0).cast("int"))
    return folds(spark, sf).groupBy("run_id", "stratum").agg(r(F.avg("value")).alias("mean"), median.alias("iterations"))


@query("A24_spread_over_seeds", _FOLDS + ", s AS (SELECT run_id, stratum, avg(value) AS v FROM f GROUP BY 1, 2) SELECT stratum, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v) / avg(v), 6) AS cv, round((max(v) - min(v)) / quantile_cont(v, 0.5), 6) AS range_over_median FROM s GROUP BY 1")
def spread_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    means = folds(spark, sf).groupBy("run_id", "stratum").agg(F.avg("value").alias("v"))
    out = search.spread(means, ["stratum"], "v")
    return out.select("stratum", *[r(c).alias(c) for c in ("median", "cv", "range_over_median")])


@query("A14_event_summaries", _FOLDS + ", s AS (SELECT run_id, count(DISTINCT gap) AS gaps, avg(value) AS mean, quantile_cont(value, 0.5) AS middle, max(value) AS worst FROM f GROUP BY 1) SELECT run_id, gaps, round(mean, 6) AS mean, round(middle, 6) AS middle, round(worst, 6) AS worst, CAST(rank() OVER (ORDER BY round(mean, 9) DESC) AS INT) AS difficulty FROM s")
def event_summaries(spark: SparkSession, sf: str) -> DataFrame:
    got = folds(spark, sf).groupBy("run_id").agg(F.count_distinct("gap").alias("gaps"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("middle"), F.max("value").alias("worst"))
    got = got.withColumn("difficulty", F.rank().over(W.orderBy(F.desc(F.round("mean", 9)))))
    return got.select("run_id", "gaps", *[r(c).alias(c) for c in ("mean", "middle", "worst")], "difficulty")


@query("J10_gap_degradation", _FOLDS + ", g AS (SELECT run_id, gap, avg(value) AS v FROM f GROUP BY 1, 2) SELECT a.run_id, CAST(a.gap AS INT) AS gap, round(a.v - b.v, 6) AS absolute, round(100 * (a.v - b.v) / nullif(b.v, 0), 6) AS percent FROM g a LEFT JOIN g b ON a.run_id = b.run_id AND b.gap = 0")
def gap_degradation(spark: SparkSession, sf: str) -> DataFrame:
    means = folds(spark, sf).groupBy("run_id", "gap").agg(F.avg("value").alias("v"))
    base = means.where("gap = 0").select("run_id", F.col("v").alias("base"))
    out = means.join(base, "run_id", "left")
    return out.select("run_id", F.col("gap").cast("int").alias("gap"), r(F.col("v") - F.col("base")).alias("absolute"), r(F.try_divide(100 * (F.col("v") - F.col("base")), "base")).alias("percent"))


@query("J13_group_median_back", _FOLDS + ", m AS (SELECT run_id, quantile_cont(value, 0.5) AS m FROM f GROUP BY 1) SELECT f.run_id, count(*) FILTER (value > m) AS above, count(*) AS n FROM f JOIN m USING (run_id) GROUP BY 1")
def group_median_back(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds(spark, sf)
    medians = rows.groupBy("run_id").agg(F.percentile("value", 0.5).alias("m"))
    return rows.join(medians, "run_id").groupBy("run_id").agg(F.count_if(F.col("value") > F.col("m")).alias("above"), F.count("*").alias("n"))


#: Columns of a forecasting frame, whose names carry their meaning.
FEATURES = ["P_Power_lag_1", "P_Power_lag_24", "P_Power_lag_168", "Q_Power_lag_1", "Q_Power_lag_24", "P_Power_rmean_24", "P_Power_rstd_168", "Q_Power_rmean_168", "Temperature", "hour_sin"]
_CATALOGUE = f"""WITH f AS (SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature), c AS (SELECT feature, CASE WHEN feature LIKE 'P\\_Power%' ESCAPE '\\' THEN 'P_Power' WHEN feature LIKE 'Q\\_Power%' ESCAPE '\\' THEN 'Q_Power' END AS owner, CASE WHEN regexp_matches(feature, '_(lag|rmean|rstd)_[0-9]+$') THEN regexp_extract(feature, '_(lag|rmean|rstd)_[0-9]+$', 1) ELSE 'static' END AS kind, CASE WHEN regexp_matches(feature, '_(lag|rmean|rstd)_[0-9]+$') THEN CAST(regexp_extract(feature, '_([0-9]+)$', 1) AS INT) END AS hours FROM f)"""


def _features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FEATURES], "feature string")


@query("P15_feature_catalogue", _CATALOGUE + " SELECT * FROM c")
def feature_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return planner.catalogue(_features(spark), ["P_Power", "Q_Power"])


@query("Q32_feature_plan", _CATALOGUE + """, s AS (SELECT unnest(['P_Power', 'Q_Power']) AS target, p.policy, w.need FROM (VALUES ('drop'), ('own'), ('mutual')) p(policy), (VALUES (24), (48)) w(need))
SELECT target, policy, CAST(need AS INT) AS need_hours, feature, CASE WHEN kind = 'static' THEN 'known' WHEN kind = 'lag' AND hours >= need AND (owner = target OR policy = 'mutual') THEN 'known' WHEN policy = 'drop' THEN 'dropped' WHEN owner = target OR policy = 'mutual' THEN 'recalculated' ELSE 'dropped' END AS use FROM c, s""")
def feature_plan(spark: SparkSession, sf: str) -> DataFrame:
    found = planner.catalogue(_features(spark), ["P_Power", "Q_Power"])
    plans = spark.createDataFrame([(t, p, n) for t in ("P_Power", "Q_Power") for p in ("drop", "own", "mutual") for n in (24, 48)], "target string, policy string, need_hours int")
    return planner.plan(found, plans)


@query("P13_clean_names", "SELECT DISTINCT p_type, trim(regexp_replace(p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS clean FROM part")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "part").select("p_type", planner.clean_name(F.col("p_type")).alias("clean")).distinct()


@query("P19_stable_hash", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS hash FROM events")
def stable_hash(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("hash"))


@query("P20_stable_seed", "SELECT DISTINCT event_type, (('0x' || substr(sha256(event_type), 1, 8))::BIGINT + 42) % 2147483647 AS seed FROM events")
def stable_seed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select("event_type", planner.stable_seed(F.col("event_type")).alias("seed")).distinct()


@query("P18_seeded_names", "SELECT DISTINCT 'run_' || event_type || '_t' || CAST(user_id % 3 AS VARCHAR) AS name, 'run_' || event_type || '_s17_t' || CAST(user_id % 3 AS VARCHAR) AS seeded FROM events")
def seeded_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("run_"), "event_type", F.lit("_t"), (F.col("user_id") % 3).cast("string"))
    rows = tables.table(spark, sf, "events").select(name.alias("name")).distinct()
    return rows.select("name", planner.seeded(F.col("name"), 17).alias("seeded"))


@query("P14_levels_from_names", "WITH c AS (SELECT unnest(['Q05', 'Q50', 'Q97.5', 'Pinball_0.25', 'Pinball_0.95', 'CRPS']) AS name) SELECT name, CASE WHEN name LIKE 'Q%' THEN CAST(regexp_extract(name, '([0-9.]+)$', 1) AS DOUBLE) / 100 WHEN name LIKE 'Pinball%' THEN CAST(regexp_extract(name, '([0-9.]+)$', 1) AS DOUBLE) END AS tau FROM c")
def levels_from_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in ("Q05", "Q50", "Q97.5", "Pinball_0.25", "Pinball_0.95", "CRPS")], "name string")
    return rows.select("name", planner.level(F.col("name")).alias("tau"))


@query("JSON_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "events").select("event_type", (F.from_json("props", "k int")["k"] % 10).alias("bucket"))
    return rows.groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("H03_binned_mutual_information", "WITH x AS (SELECT l_quantity AS a, ntile(8) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS b FROM lineitem), j AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT sum(n) AS t FROM j) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mutual_information FROM (SELECT j.*, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM j), s")
def binned_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem")
    return planner.mutual_information(rows, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"], 8).select(r("mutual_information").alias("mutual_information"))


@query("L03_top_k_features", "WITH s AS (SELECT l_shipmode AS feature, avg(l_discount) AS score, min(l_orderkey) AS place FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1) SELECT feature, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, feature) AS INT) AS rank FROM s QUALIFY rank <= 3")
def top_k_features(spark: SparkSession, sf: str) -> DataFrame:
    scores = tables.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("feature")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "feature"))).where("rank <= 3").select("feature", "rank")


@query("U02_nested_union", "WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM c) SELECT strftime(d, '%Y-%m-%d') AS d, design FROM k, (VALUES ('core24', 24), ('nested36', 36), ('nested48', 48)) v(design, n) WHERE i <= n")
def nested_union(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().orderBy("d").limit(48)
    ranked = days.withColumn("i", F.row_number().over(W.orderBy("d")))
    parts = [ranked.where(F.col("i") <= n).select(F.date_format("d", "yyyy-MM-dd").alias("d"), F.lit(name).alias("design")) for name, n in (("core24", 24), ("nested36", 36), ("nested48", 48))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("U05_disjoint_origins", "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity > 49) SELECT strftime(d, '%Y-%m-%d') AS d FROM (SELECT d FROM a INTERSECT SELECT d FROM b)")
def disjoint_origins(spark: SparkSession, sf: str) -> DataFrame:
    a = tables.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("d"))
    b = tables.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("d"))
    return a.intersect(b).select(F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("U10_specification_duplicates", "WITH s AS (SELECT c_custkey, c_nationkey, c_mktsegment, sha256(CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment) AS h FROM customer) SELECT c_custkey, min(c_custkey) OVER (PARTITION BY h) AS canonical FROM s")
def specification_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer")
    spec = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("run_id"), F.col("c_custkey").cast("string"))
    kept = F.map_filter(spec, lambda k, _: k != "run_id")
    signed = rows.select("c_custkey", F.sha2(F.to_json(kept), 256).alias("h"))
    least = signed.groupBy("h").agg(F.min("c_custkey").alias("canonical"))
    return signed.join(least, "h").select("c_custkey", "canonical")

"""Readers of results and sinks, on small tables in temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from tidecast.operators import audit, dm, features, grid, guards
from tidecast.sources import results, sinks

HOURS = "explode(sequence(timestamp_ntz '2024-01-01 00:00:00', timestamp_ntz '2024-01-02 23:00:00', interval 1 hour)) as ts"


def hours(spark):
    return spark.sql(f"select {HOURS}").withColumns({"y_true": F.hour("ts").cast("string"), "y_pred": F.lit("1.5"), "Q50": F.lit(1.0)})


def test_sheets_and_their_checks(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    rows = spark.sql(f"select {HOURS}").select(F.col("ts").alias("DateTime"), F.lit(1.0).alias("P_Power"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sheet"))
    rows.write.partitionBy("sheet").parquet(path)
    assert results.sheets(spark, path, 2).count() == 96
    with pytest.raises(ValueError, match="2 sheets"):
        results.sheets(spark, path, 3)
    assert results.sheet(spark, path, "a", {"ts": "timestamp_ntz", "P_Power": "double"}).count() == 48
    with pytest.raises(ValueError, match="P_Power double"):
        results.sheet(spark, path, "a", {"P_Power": "int"})
    with pytest.raises(ValueError, match="no sheet"):
        results.sheet(spark, path, "z", {"P_Power": "double"})


def test_loose_stamps_and_splits(spark):
    rows = spark.createDataFrame([("2024-01-01 03:25:00", 1), ("nonsense", 2)], "first string, v int")
    assert [(str(r.ts), r.v) for r in results.with_stamps(rows, first_if_none=True, floor=True).collect()] == [("2024-01-01 03:00:00", 1)]
    with pytest.raises(ValueError, match="no stamp column"):
        results.with_stamps(rows)
    split = spark.createDataFrame([("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "x", 1)], ["Train Start", "train_END", "TestStart", "test end", "Scheme", "Unnamed: 0"])
    assert results.splits_table(split).columns == ["train_start", "train_end", "test_start", "test_end", "scheme"]
    with pytest.raises(ValueError, match="test_end"):
        results.splits_table(split.drop("test end"))


def test_weather_and_sun(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Datetime,Temperature,Rainy\n2024-01-01 00:00:00,1.5,0\n2024-01-01 00:00:00,2.5,1\n2024-01-01 01:00:00,x,1\n")
    got = {str(r.ts): (r.Temperature, r.Rainy) for r in results.weather(spark, f"file://{tmp_path}/w.csv", ["Temperature", "Rainy"]).collect()}
    assert got == {"2024-01-01 00:00:00": (2.5, 1.0), "2024-01-01 01:00:00": (None, 1.0)}
    (tmp_path / "s.csv").write_text("date,sunrise,sunset,day_length\n2024-01-01,07:56:58,16:00:00,8h 3m 2s\n2024-01-02,07:56:00,16:00:00,\n")
    got = results.sun_times(spark, f"file://{tmp_path}/s.csv").orderBy("date").collect()
    assert [(r.sunrise, r.day_seconds) for r in got] == [(28618, 8 * 3600 + 182), (28560, 57600 - 28560)]


def test_candidates_and_systems(spark):
    full = ["ts", "y_true", "y_pred", "Q50"]
    rows = [(f"/r/good/{t}_predictions.parquet", full) for t in ("P_Power", "Q_Power")] + [("/r/half/P_Power_predictions.parquet", full), ("/r/bad/P_Power_predictions.parquet", full), ("/r/bad/Q_Power_predictions.parquet", ["ts"]), ("/r/tmp/~P_Power_predictions.parquet", full), ("/r/gone/P_Power_predictions.parquet", None)]
    rows += [(f"/r/naive/{t}_predictions.parquet", full) for t in ("P_Power", "Q_Power")]
    got = results.candidates(spark.createDataFrame(rows, "path string, columns array<string>"), ["naive"])
    assert {r.system: r.reason for r in got.collect()} == {"good": None, "half": "a target is missing", "bad": "a column is missing", "tmp": "temporary", "gone": "unreadable", "naive": "a baseline"}
    systems = results.publication_systems(spark.createDataFrame([("good",), ("half",), ("new",)], "system string"), got)
    assert {r.system: (r.available, r.why_not) for r in systems.collect()} == {"good": (True, None), "half": (False, "a target is missing"), "new": (False, "no predictions")}


def test_predictions_are_checked(spark, tmp_path):
    got = results.predictions(hours(spark), "2024-01-02 00:00:00").orderBy("ts").collect()
    assert len(got) == 24 and got[0].horizon == 1 and got[23].horizon == 24 and got[5].y_true == 5.0 and got[5].Q50 == 1.0
    with pytest.raises(Exception, match="stands twice"):
        results.predictions(hours(spark).unionByName(hours(spark).limit(1))).collect()
    with pytest.raises(Exception, match="is missing"):
        results.predictions(hours(spark).withColumn("y_pred", F.lit("x"))).collect()
    path = f"file://{tmp_path}/p"
    hours(spark).write.parquet(path)
    assert results.stored_predictions(spark, path, 24).count() == 48
    short = f"file://{tmp_path}/q"
    hours(spark).where("not (hour(ts) = 5 and to_date(ts) = date '2024-01-02')").write.parquet(short)
    with pytest.raises(ValueError, match="2024-01-02 wrong length"):
        results.stored_predictions(spark, short, 24)


def test_archives_and_registry(spark):
    a = spark.createDataFrame([("s1", "2021-12-01", 1.0), ("s2", "2022-03-01", 2.0)], "snapshot string, origin string, v double").withColumn("origin", F.to_date("origin"))
    mapping = spark.createDataFrame([("C1", "s1", "old"), ("C2", "s2", "new")], "configuration string, snapshot string, source string")
    got = results.archived({"old": a, "new": a}, mapping, "2021-12-31").collect()
    assert {(r.configuration, r.source, r.period, r.v) for r in got} == {("C1", "old", "primary", 1.0), ("C2", "new", "late", 2.0)}
    manifest = spark.createDataFrame([("a", "/a"), ("old_b", "/b"), ("again", "/a")], "name string, path string")
    wanted, legacy = spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), spark.createDataFrame([("b", "old_b")], "name string, legacy_name string")
    assert {r.name: r.path for r in results.registered(manifest, wanted, legacy).collect()}["b"] == "/b"


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert [sinks.run_directory(spark, root, "run").rsplit("/", 1)[1] for _ in range(3)] == ["run", "run_2", "run_3"]
    for k in (1, 2):
        sinks.write_json(spark, f"{root}/x.json", {"k": k})
        assert json.loads((tmp_path / "x.json").read_text()) == {"k": k}
    assert sinks.write_checked(spark.range(5), f"{root}/t", ["id"]) == 5
    with pytest.raises(ValueError, match="6 rows, 5 keys"):
        sinks.write_checked(spark.range(5).unionByName(spark.range(1)), f"{root}/u", ["id"])
    trials = spark.createDataFrame([(1, 1, "COMPLETE", 2, 1.0), (1, 2, "PRUNED", 1, 0.5)], "run_id int, trial int, state string, fits int, seconds double")
    folds = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0)], "run_id int, trial int, fold int")
    sinks.export_trials(trials, folds, f"{root}/search")
    assert spark.read.parquet(f"{root}/search/trials_long").count() == 3
    assert spark.read.json(f"{root}/search/cost").first().fits == 3


def test_models_are_saved_with_their_names(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, LinearRegressionModel

    rows = VectorAssembler(inputCols=["id"], outputCol="features").transform(spark.range(10).withColumn("label", F.col("id") * 2.0))
    sinks.save_model(LinearRegression().fit(rows), f"file://{tmp_path}/m", ["id"], "P_Power")
    model, meta = sinks.load_model(spark, f"file://{tmp_path}/m", LinearRegressionModel)
    assert meta["features"] == ["id"] and abs(model.coefficients[0] - 2) < 1e-6


def test_faults_that_whole_tables_do_not_have(spark):
    rows = spark.sql(f"select {HOURS}").select(F.lit("P").alias("target"), "ts", F.hour("ts").cast("double").alias("y"))
    gaps = audit.recursion_gaps(rows.where("hour(ts) <> 5"), "2023-12-31 23:00:00", "2024-01-02 23:00:00").first()
    assert (gaps.expected, gaps.present, gaps.missing, gaps.beyond) == (48, 46, 2, 0)
    told = rows.select(F.lit("m").alias("model_id"), "target", "ts", F.to_date("ts").alias("date"), (F.hour("ts") + 1).alias("horizon"))
    faults = audit.trajectory_faults(told.where("not (date = date '2024-01-02' and horizon = 7)")).first()
    assert (faults.origins, faults.faulty) == (2, 1)
    both = told.unionByName(told.withColumn("model_id", F.lit("n")).where("horizon <> 3"))
    assert grid.common_stamps(both).count() == 46
    by_time = features.rolling_by_time(rows.where("hour(ts) % 5 <> 2"), 24).orderBy("ts").collect()
    assert by_time[-1].n_back == 19
    cells = audit.cell_counts(spark.createDataFrame([("a", 1), ("b", 2)], "s string, k int"), "s", "k").collect()
    assert {(r.s, r.k): r.n for r in cells} == {("a", 1): 1, ("a", 2): 0, ("b", 1): 0, ("b", 2): 1}
    recursive = features.rolling_recursive(rows.where("hour(ts) <> 5").withColumnRenamed("y", "value"), [24], "2024-01-02 00:00:00", "2024-01-02 00:00:00").first()
    assert recursive.missing_24 == 1


def test_one_to_one_refuses(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    assert guards.one_to_one(a, b, ["id"]).count() == 3
    for wrong in (b.limit(2), b.unionByName(b.limit(1))):
        with pytest.raises(Exception, match="one to one"):
            guards.one_to_one(a, wrong, ["id"]).collect()


def test_critical_values(spark):
    # two-sided 5 % points of Student's t, as tables give them
    want = {1: 12.7062, 2: 4.3027, 5: 2.5706, 10: 2.2281, 21: 2.0796, 22: 2.0739, 53: 2.0057, 120: 1.9799}
    rows = spark.createDataFrame([(k,) for k in want], "df long")
    got = {r.df: (r.t, r.p) for r in rows.withColumn("t", dm.t_critical(F.col("df"))).withColumn("p", dm.t_two_sided(F.col("t"), F.col("df"))).collect()}
    for k, t in want.items():
        assert abs(got[k][0] - t) < 1e-4 and abs(got[k][1] - 0.05) < 1e-9

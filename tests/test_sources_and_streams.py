"""Files and streams: round trips on temporary folders, and the stream against its batch form."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidecast.operators import learners
from tidecast.sources import files
from tidecast.streaming import hourly

SF = "/root/testdata/sf0.001"


def test_model_pairs(spark, tmp_path):
    def meta(name, **fields):
        (tmp_path / name).write_text(json.dumps({"model": "LGBM", "features": ["a"], "best_params": {"k": "1"}} | fields, indent=1))

    for target in ("P_Power", "Q_Power"):
        meta(f"own_LGBM_sheet0_{target}_best.meta.json", target=target, lag_policy="own")
        meta(f"mixed_LGBM_sheet1_{target}_best.meta.json", target=target, lag_policy=target)
    meta("lone_LGBM_sheet2_P_Power_best.meta.json", target="P_Power", lag_policy="drop")
    got = files.model_pairs(files.model_metas(spark, f"file://{tmp_path}")).collect()
    assert {(r.family, r.sheet): r.reason for r in got} == {("own", 0): None, ("mixed", 1): "lag policies differ", ("lone", 2): "a target is missing"}
    assert {r.family for r in got if r.usable} == {"own"}


def test_sinks_keep_order_and_refuse_to_overwrite(spark, tmp_path):
    rows = spark.range(4).select((F.col("id") % 2).alias("lag_set"), F.col("id").alias("b"), F.lit(1.5).alias("a"))
    path = f"file://{tmp_path}/out"
    files.write_table(rows, path, ["a", "b", "lag_set"], by=["lag_set"])
    assert spark.read.parquet(path).columns == ["a", "b", "lag_set"]
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_table(rows, path, ["a"])
    files.write_table(rows, path, ["a"], kind="csv", replace=True)
    assert spark.read.option("header", True).csv(path).columns == ["a"]


def test_manifest(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"abc")
    got = files.manifest(spark, f"file://{tmp_path}").collect()
    assert [(r.file, r.bytes, r.sha256) for r in got] == [("x.txt", 3, hashlib.sha256(b"abc").hexdigest())]


def test_names(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "`Train  Start` int, `Unnamed: 0` int, other int")
    assert files.normalise_names(rows, {r"train.*start": "train_start"}).columns == ["train_start", "other"]


def test_closed_hours_of_the_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = hourly.write_stream(hourly.hourly_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    last = events.agg(F.max("ts").alias("m")).first().m
    closed = hourly.hourly_batch(events).where(F.col("ts") + F.expr("interval 3 hours") <= F.lit(last))

    def rows(df):
        return sorted((r.ts, r.event_type, r.n, round(r.total, 6)) for r in df.collect())

    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got and got == rows(closed)


def test_bootstrap_does_not_depend_on_partitions(spark):
    errors = spark.range(200).select(F.lit("m").alias("model_id"), F.when(F.col("id") % 2 == 0, "P").otherwise("Q").alias("target"), F.col("id").alias("ts"), F.sin("id").alias("error"))
    one = sorted(map(tuple, learners.block_bootstrap_bounds(errors.repartition(1), ["model_id", "target"]).collect()))
    many = sorted(map(tuple, learners.block_bootstrap_bounds(errors.repartition(7), ["model_id", "target"]).collect()))
    assert one == many and all(r[2] <= r[3] for r in one)

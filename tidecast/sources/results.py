"""Reading prepared frames, splits, weather and stored predictions: names found loosely, contents checked strictly.

A workbook is a folder of tables here; a sheet is a partition `sheet=<name>` of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.sources.files import normalise_names

#: Patterns by which the columns of a table of splits are known, in lower case.
SPLIT_NAMES = {r"train.*start": "train_start", r"train.*end": "train_end", r"test.*start": "test_start", r"test.*end": "test_end", r"scheme": "scheme"}
_STAMPS = ("datetime", "timestamp", "date", "ts")


def stamp_column(df: DataFrame, first_if_none: bool = False) -> str:
    """The column that holds stamps, whatever its case; the first column, if none is named so and that is asked for."""
    low = {c.lower(): c for c in reversed(df.columns)}
    found = next((low[n] for n in _STAMPS if n in low), None)
    if found is None and not first_if_none:
        raise ValueError(f"no stamp column among {df.columns}")
    return found or df.columns[0]


def with_stamps(df: DataFrame, first_if_none: bool = False, floor: bool = False) -> DataFrame:
    """df with its stamps as ts, first; rows without a readable one go; floor cuts them to the hour."""
    name = stamp_column(df, first_if_none)
    ts = F.col(f"`{name}`").try_cast("timestamp_ntz") if dict(df.dtypes)[name] != "timestamp_ntz" else F.col(f"`{name}`")
    ts = F.date_trunc("hour", ts.cast("timestamp")).cast("timestamp_ntz") if floor else ts
    return df.select(ts.alias("ts"), *[F.col(f"`{c}`") for c in df.columns if c != name]).where("ts is not null")


def sheets(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """All sheets of a folder as one frame with `sheet`; a wrong number of sheets is refused."""
    out = with_stamps(spark.read.parquet(path))
    if "sheet" not in out.columns:
        raise ValueError(f"{path} has no sheets")
    if expected is not None and (n := out.select("sheet").distinct().count()) != expected:
        raise ValueError(f"{path} has {n} sheets, not {expected}")
    return out


def sheet(spark: SparkSession, path: str, name: str | int, required: dict[str, str]) -> DataFrame:
    """One sheet (only its partition is read), which must have the required columns in their types."""
    out = with_stamps(spark.read.parquet(path).where(F.col("sheet") == F.lit(name)).drop("sheet"))
    kinds = dict(out.dtypes)
    wrong = [f"{c} {kinds.get(c, 'is missing')}" for c, kind in required.items() if kinds.get(c) != kind]
    if wrong:
        raise ValueError(f"{path}, sheet {name}: {', '.join(wrong)}")
    if out.isEmpty():
        raise ValueError(f"{path} has no sheet {name}")
    return out


def splits_table(df: DataFrame) -> DataFrame:
    """A table of splits with its loosely named columns under their own names; unnamed columns go."""
    out = normalise_names(df, SPLIT_NAMES)
    missing = [c for c in ("train_start", "train_end", "test_start", "test_end") if c not in out.columns]
    if missing:
        raise ValueError(f"splits without {', '.join(missing)}")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("train_start", "train_end", "test_start", "test_end")})


def weather(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Hourly weather: ts and the named columns as doubles, the last row of a repeated hour."""
    rows = with_stamps(spark.read.option("header", True).csv(path))
    rows = rows.select("ts", F.monotonically_increasing_id().alias("_at"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    last = rows.groupBy("ts").agg(F.max_by(F.struct(*columns), "_at").alias("r"))
    return last.select("ts", "r.*")


def sun_times(spark: SparkSession, path: str) -> DataFrame:
    """(date, sunrise, sunset, day_seconds) from clock texts such as 07:56:58; the day's length from the two, where it is not given
    as 8h 8m 23s."""
    rows = spark.read.option("header", True).csv(path)
    low = {c.lower(): c for c in rows.columns}

    def clock(c: str) -> Column:
        part = lambda k: F.regexp_extract(F.col(f"`{low[c]}`"), r"^\s*(\d{1,2}):(\d{2}):(\d{2})", k).try_cast("int")
        return part(1) * 3600 + part(2) * 60 + part(3)

    between = F.col("sunset") - F.col("sunrise")
    out = rows.select(F.to_date(F.col(f"`{low['date']}`")).alias("date"), clock("sunrise").alias("sunrise"), clock("sunset").alias("sunset"), *([F.col(f"`{low['day_length']}`").alias("told")] if "day_length" in low else []))
    if "day_length" in low:
        told = lambda k: F.regexp_extract("told", r"(\d+)h\s*(\d+)m\s*(\d+)s", k).try_cast("int")
        between = F.coalesce(told(1) * 3600 + told(2) * 60 + told(3), between)
    return out.withColumn("day_seconds", between).select("date", "sunrise", "sunset", "day_seconds")


def candidates(files: DataFrame, baselines: list[str]) -> DataFrame:
    """(system, usable, reason) from files (path, columns): a system is the folder of a table of each target's predictions;
    temporary files, baselines and tables that lack a column or a target are told with the reason."""
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^(P_Power|Q_Power)_predictions", k)
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("system"), name.alias("file"), part(1).alias("target"), "columns")
    needed = F.array(*[F.lit(c) for c in ("ts", "y_true", "y_pred")])
    rows = rows.withColumn("fault", F.when(F.col("file").rlike(r"^[~._]"), "temporary").when(F.col("columns").isNull(), "unreadable").when(F.col("target") == "", "not predictions").when(F.size(F.array_except(needed, "columns")) > 0, "a column is missing"))
    got = rows.groupBy("system").agg(F.count_distinct(F.when(F.col("fault").isNull(), F.col("target"))).alias("targets"), F.min("fault").alias("fault"))
    reason = F.when(F.col("system").isin(baselines), "a baseline").when(F.col("targets") < 2, F.coalesce("fault", F.lit("a target is missing")))
    return got.select("system", reason.isNull().alias("usable"), reason.alias("reason"))


def predictions(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ts, date, horizon, y_true, y_pred, ...): numbers read as such, rows of the period, horizons counted within the day.

    Rows without a stamp or number make the query fail, and so does a stamp that stands twice.
    """
    extra = [c for c in rows.columns if c not in ("ts", "y_true", "y_pred", "date", "horizon")]
    got = rows.select(F.col("ts").try_cast("timestamp_ntz").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in ("y_true", "y_pred")], *extra)
    whole = F.col("ts").isNotNull() & F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    twice = F.count("*").over(W.partitionBy("ts")) > 1
    fault = F.when(~whole, F.raise_error(F.lit("a stamp or number is missing"))).when(twice, F.raise_error(F.lit("a stamp stands twice")))
    got = got.withColumn("_fault", fault.cast("string")).where("_fault is null").drop("_fault").withColumn("date", F.to_date("ts"))
    if start:
        got = got.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        got = got.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    number = F.row_number().over(W.partitionBy("date").orderBy("ts"))
    return got.select("ts", "date", number.alias("horizon"), "y_true", "y_pred", *extra)


def day_faults(found: DataFrame, hours: int) -> DataFrame:
    """(date, n, fault): days of another length than hours, or whose stamps do not follow hour by hour."""
    step = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    got = found.groupBy("date").agg(F.count("*").alias("n"), step.alias("span"))
    fault = F.when(F.col("n") != hours, "wrong length").when(F.col("span") != (hours - 1) * 3600, "not hour by hour")
    return got.withColumn("fault", fault).where("fault is not null").select("date", "n", "fault")


def stored_predictions(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """Predictions of one system and target; only the three columns are read, and days must be whole."""
    found = predictions(spark.read.parquet(path).select("ts", "y_true", "y_pred"))
    if (bad := day_faults(found, hours).first()) is not None:
        raise ValueError(f"{path}: {bad.date} {bad.fault}")
    return found


def publication_systems(summary: DataFrame, found: DataFrame) -> DataFrame:
    """summary (system, ...) with available and why not, by what candidates() found."""
    reason = F.when(F.col("usable").isNull(), "no predictions").when(~F.col("usable"), F.col("reason"))
    return summary.join(found, "system", "left").withColumn("why_not", reason).withColumn("available", F.col("why_not").isNull()).drop("usable", "reason")


def archived(sources: dict[str, DataFrame], mapping: DataFrame, last_day: str) -> DataFrame:
    """The rows of the source that the mapping (configuration, snapshot, source) names for each configuration, with the period
    that their origin falls in."""
    union = None
    for name, rows in sorted(sources.items()):
        part = rows.join(F.broadcast(mapping.where(F.col("source") == name).select("configuration", "snapshot", "source")), "snapshot")
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    if union is None:
        raise ValueError("no sources")
    return union.withColumn("period", F.when(F.col("origin") <= F.lit(last_day).cast("date"), "primary").otherwise("late"))


def registered(manifest: DataFrame, wanted: DataFrame, legacy: DataFrame) -> DataFrame:
    """(name, path): the manifest's path of each wanted name, else that of its legacy name; each path once."""
    paths = manifest.select("name", "path").dropDuplicates(["path"])
    old = legacy.join(paths.select(F.col("name").alias("legacy_name"), F.col("path").alias("_old")), "legacy_name")
    got = wanted.join(paths, "name", "left").join(old.groupBy("name").agg(F.min("_old").alias("_old")), "name", "left")
    return got.groupBy("name").agg(F.min(F.coalesce("path", "_old")).alias("path"))

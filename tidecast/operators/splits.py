"""Leakage-safe rolling splits, as rows generated by sequences and checked by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_midnight(t: Column) -> Column:
    """The stamp's own midnight at hour 0, else the following one."""
    day = F.date_trunc("day", t.cast("timestamp")).cast("timestamp_ntz")
    return F.when(day == t, t).otherwise(day + F.expr("interval 1 day"))


def _split(start: Column, end: Column, scheme: str, extra: Column, shift: Column, days_after: int) -> list[Column]:
    test = next_midnight(end + F.expr(f"interval {days_after} days"))
    return [start.alias("train_start"), end.alias("train_end"), test.alias("test_start"), (test + F.expr("interval 23 hours")).alias("test_end"), F.lit(scheme).alias("scheme"), extra.cast("int").alias("extra_days"), shift.cast("int").alias("shift_days")]


def candidates(bounds: DataFrame, months: int = 12, days_after: int = 7) -> DataFrame:
    """All candidate splits of the four schemes from bounds (first, last), with seq, the order of their making."""
    none = F.lit(None)
    hour = F.expr("interval 1 hour")
    month_end = lambda k: F.col("first").cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), k) - hour
    new_year = F.make_date(F.year("first") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    anchor = bounds.select(*_split(F.col("first"), new_year - F.expr("interval 7 days") - hour, "anchor_new_year", none, none, days_after), F.lit(0).alias("seq"), "last")
    m = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("m")
    cumulative = bounds.select("first", "last", m).select(*_split(F.col("first"), month_end(F.col("m")), "cumulative_months", none, none, days_after), (F.lit(100) + F.col("m")).alias("seq"), "last")
    weeks = F.expr("explode(sequence(0, cast(datediff(last, first) / 7 as int)))").alias("w")
    begin = F.col("first") + F.make_dt_interval(F.col("w") * 7)
    fixed = bounds.select("first", "last", weeks).select(*_split(begin, begin + F.expr("interval 1 month") - hour, "fixed_1m_step7d", none, F.col("w") * 7, days_after), (F.lit(1000) + F.col("w")).alias("seq"), "last")
    plus = bounds.select("first", "last", m).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(6))))
    plus = plus.select(*_split(F.col("first"), month_end(F.col("m")) + F.make_dt_interval(F.col("d")), "cum_m_plus_days", F.col("d"), none, days_after), (F.lit(100000) + F.col("m") * 10 + F.col("d")).alias("seq"), "last")
    return anchor.unionByName(cumulative).unionByName(fixed).unionByName(plus)


def rolling_splits(bounds: DataFrame, months: int = 12, days_after: int = 7) -> DataFrame:
    """Candidates whose test day lies within the data, once for each (train_start, test_start) in the order of their making."""
    inside = candidates(bounds, months, days_after).where("test_start <= last and train_end <= last")
    first = F.row_number().over(W.partitionBy("train_start", "test_start").orderBy("seq"))
    return inside.withColumn("_k", first).where("_k = 1").drop("_k", "last")


def day_blocks(bounds: DataFrame, start: str, end: str, window_days: int | None = None) -> DataFrame:
    """(day, train_start, train_end): a walk-forward block for each day, expanding or of a fixed number of days."""
    days = bounds.select("first", F.explode(F.expr(f"sequence(timestamp_ntz '{start}', timestamp_ntz '{end}', interval 1 day)")).alias("day"))
    begin = F.col("first") if window_days is None else F.greatest(F.col("first"), F.col("day") - F.expr(f"interval {window_days} days"))
    return days.select("day", begin.alias("train_start"), (F.col("day") - F.expr("interval 1 hour")).alias("train_end"))


def members(splits: DataFrame, hours: DataFrame, ts: str = "ts") -> DataFrame:
    """(split keys, n_train, n_test): membership counts.  Hours and splits meet by the day, so that the range join is an
    equi-join on days and no split meets all hours at once."""
    by_day = hours.groupBy(F.to_date(ts).alias("day")).agg(F.array_sort(F.collect_list(ts)).alias("stamps"))
    spans = splits.select("*", F.explode(F.expr("sequence(to_date(train_start), to_date(test_end))")).alias("day"))
    met = spans.join(by_day, "day").withColumn("t", F.explode("stamps"))
    train = (F.col("t") >= F.col("train_start")) & (F.col("t") <= F.col("train_end"))
    test = (F.col("t") >= F.col("test_start")) & (F.col("t") <= F.col("test_end"))
    return met.groupBy("scheme", "train_start", "train_end", "test_start", "test_end").agg(F.sum(train.cast("long")).alias("n_train"), F.sum(test.cast("long")).alias("n_test"))


def _spread(place: str, among: str, wanted: str) -> Column:
    """Is the place one of `wanted` places spread evenly over `among` (rounded half to even)?"""
    return F.expr(f"{wanted} > 0 and array_contains(transform(sequence(0, greatest({wanted}, 1) - 1), j -> cast(bround(j * ({among} - 1) / greatest({wanted} - 1, 1), 0) as int)), {place})")


def pick(splits: DataFrame, most: int, strategy: str, order: str = "test_start") -> DataFrame:
    """`all`, the `first`, an `even` or a `stratified` choice of most splits.

    `stratified` gives each scheme an equal quota, the remainder to the schemes that sort first, spreads it over the scheme's
    splits in time, and tops up, where a scheme has fewer, from the others in the order of their making.
    """
    if strategy == "all":
        return splits
    every = W.partitionBy()
    k = splits.withColumns({"_k": F.row_number().over(W.orderBy(order, "seq")) - 1, "_n": F.count("*").over(every).cast("int")})
    if strategy == "first":
        return k.where(F.col("_k") < most).drop("_k", "_n")
    if strategy == "even":
        return k.where((F.col("_n") <= most) | _spread("_k", "_n", str(most))).drop("_k", "_n")
    if strategy != "stratified":
        raise ValueError(f"no such strategy: {strategy}")
    k = k.withColumns({"_g": F.dense_rank().over(W.orderBy("scheme")) - 1, "_s": F.row_number().over(W.partitionBy("scheme").orderBy(order, "seq")) - 1, "_m": F.count("*").over(W.partitionBy("scheme")).cast("int")})
    k = k.withColumn("_groups", F.max("_g").over(every) + 1)
    k = k.withColumn("_quota", F.expr(f"least(_m, cast({most} div _groups as int) + if(_g < {most} % _groups, 1, 0))"))
    k = k.withColumn("_in", _spread("_s", "_m", "_quota"))
    k = k.withColumn("_need", F.lit(most) - F.sum(F.col("_in").cast("int")).over(every).cast("int"))
    k = k.withColumns({"_r": F.row_number().over(W.partitionBy("_in").orderBy("seq")) - 1, "_left": F.count("*").over(W.partitionBy("_in")).cast("int")})
    k = k.withColumn("_take", F.least("_need", "_left"))
    chosen = (F.col("_n") <= most) | F.col("_in") | _spread("_r", "_left", "_take")
    return k.where(chosen).drop("_k", "_n", "_g", "_s", "_m", "_groups", "_quota", "_in", "_need", "_r", "_left", "_take")


def refit_bounds(splits: DataFrame) -> DataFrame:
    """(policy, fit_start, fit_end) of the final refit under each policy, from one aggregate over the splits."""
    got = splits.agg(F.min("train_start").alias("start"), F.max("train_end").alias("train"), F.max("test_end").alias("test"), F.max(F.struct("train_end", F.expr("-unix_timestamp(cast(train_start as timestamp))").alias("s"), "train_start")).alias("last"))
    year_end = F.expr("make_timestamp_ntz(year(test), 12, 31, 23, 0, 0)")
    rows = [("through_split_year_end", F.col("start"), year_end), ("through_last_test_end", F.col("start"), F.col("test")), ("through_last_train_end", F.col("start"), F.col("train")), ("last_train_window", F.col("last.train_start"), F.col("train"))]
    return got.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), a.alias("fit_start"), b.alias("fit_end")) for p, a, b in rows])).alias("r")).select("r.*")

"""Calendar, season, solar and holiday expressions; each is a projection, so that Catalyst folds them into the scan's stage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of the period."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def fixed_utc2(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A clock reading at a fixed two hours east, as an instant; null where it cannot be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), "Etc/GMT-2")


def civil(instant: Column, zone: str = "Europe/Kyiv") -> Column:
    """An instant as civil time of a zone with summer time."""
    return F.from_utc_timestamp(instant, zone)


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, day of week (Monday 0), day, month, day of year, weekend, and their circles (24, 7 and 366)."""
    t = F.col(ts)
    out = df.withColumns({"hour": F.hour(t), "dow": F.weekday(t), "dom": F.day(t), "month": F.month(t), "doy": F.dayofyear(t)})
    out = out.withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
    for name, period in (("hour", 24), ("dow", 7), ("doy", 366)):
        sine, cosine = cycle(F.col(name), period)
        out = out.withColumns({f"{name}_sin": sine, f"{name}_cos": cosine})
    return out


def season_features(df: DataFrame, ts: str = "ts", south: bool = False) -> DataFrame:
    """Meteorological season: index (winter 0), its circle, day and length of the season, and the phase's circle."""
    d, m = F.to_date(ts), F.month(ts)
    start = F.when(m == 12, F.make_date(F.year(ts), F.lit(12), F.lit(1))).when(m <= 2, F.make_date(F.year(ts) - 1, F.lit(12), F.lit(1)))
    start = start.otherwise(F.make_date(F.year(ts), (F.floor(m / 3) * 3).cast("int"), F.lit(1)))
    north = F.floor((m % 12) / 3).cast("int")
    out = df.withColumns({"season_start": start, "season_idx": (north + 2) % 4 if south else north})
    out = out.withColumn("season_len", F.datediff(F.add_months("season_start", 3), "season_start"))
    out = out.withColumn("day_in_season", F.datediff(d, "season_start") + 1)
    around, ahead = cycle(F.col("season_idx"), 4)
    phase_sin, phase_cos = cycle((F.col("day_in_season") - 1) / F.col("season_len"), 1)
    return out.withColumns({"season_sin": around, "season_cos": ahead, "season_phase_sin": phase_sin, "season_phase_cos": phase_cos})


def holiday_features(df: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """Holiday flags of the civil date and of its neighbours, weekend, fixed dates and the decay after New Year.

    holidays: (d) distinct dates, a small dimension; the three look-ups are joins on the date.
    """
    days = holidays.select(F.col("d").alias("hd")).distinct()
    out = df.withColumn("d", F.to_date(ts))
    for name, shift in (("is_holiday", 0), ("is_day_before_hol", 1), ("is_day_after_hol", -1)):
        found = days.select(F.date_sub("hd", shift).alias("d"), F.lit(1).alias(name))
        out = out.join(found, "d", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    day = F.date_format("d", "MM-dd")
    flags = {"is_new_year": "01-01", "is_jan2": "01-02", "is_old_new_year": "01-14", "is_orthxmas": "01-07", "is_dec25": "12-25"}
    out = out.withColumn("is_weekend", (F.weekday("d") >= 5).cast("int")).withColumns({k: (day == v).cast("int") for k, v in flags.items()})
    doy = F.dayofyear("d")
    return out.withColumn("post_ny_decay", F.when(doy <= 14, F.exp(-(doy - 1) / 3.0)).otherwise(0.0))


def day_length_minutes(text: Column) -> Column:
    """Minutes of a length written like `8h 8m 23s`."""
    part = [F.regexp_extract(text, rf"(\d+)\s*{unit}", 1) for unit in "hms"]
    hours, minutes, seconds = (F.when(p == "", 0.0).otherwise(p.try_cast("double")) for p in part)
    return hours * 60 + minutes + seconds / 60


def daylight(minute: Column, sunrise: Column, length: Column) -> Column:
    """Half a sine over daylight, rounded to five places; zero at night and where the day has no length."""
    phase = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (minute - sunrise) / length))).otherwise(0.0)
    return F.round(F.sin(F.lit(math.pi) * phase), 5)

"""Counts by time bin and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = {"1h": "1 hour", "3h": "3 hours", "6h": "6 hours", "1d": "1 day", "3d": "3 days", "7d": "7 days", "14d": "14 days", "1w": "week"}


def time_bin(time: Column, interval: str) -> Column:
    """Start of the bin; weeks begin on Monday, other bins count from 1970-01-01 00:00 UTC."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; known: {', '.join(INTERVALS)}")
    if interval == "1w":
        return F.date_trunc("week", time)
    number, unit = INTERVALS[interval].split()
    seconds = int(number) * (3600 if unit.startswith("hour") else 86400)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(time) / seconds) * seconds)


def feature_counts(df: DataFrame, feature: str, time: str, intervals: Sequence[str], by: Sequence[str] = (),
                   audio: str | None = None, hashtags: str | None = None, strict_compat: bool = False) -> DataFrame:
    """(interval, time_bin, feature, count, unique_audio_ids, unique_hashtags) for an array or scalar column ``feature``.

    One pass serves all intervals: the bins are exploded beside the features and partial counts are shuffled, not rows.
    Null features and empty arrays vanish. unique_hashtags counts the distinct tags of the texts in a group; with
    ``strict_compat`` and tags as the feature it is the number of distinct characters of the tag."""
    is_array = dict(df.dtypes)[feature].startswith("array")
    base = df.select(*by, F.col(time).alias("_time"), F.col(feature).alias("_feature"),
                     (F.col(audio) if audio else F.lit(None).cast("string")).alias("_audio"),
                     (F.col(hashtags) if hashtags else F.lit(None).cast("array<string>")).alias("_tags"))
    one = base.withColumn("feature", F.explode("_feature") if is_array else F.col("_feature").cast("string")).filter("feature is not null and _time is not null")
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), time_bin(F.col("_time"), i).alias("time_bin")) for i in intervals]))
    one = one.withColumn("_bin", bins).select(*by, "_bin.*", "feature", "_audio", "_tags")
    keys = [*by, "interval", "time_bin", "feature"]
    out = one.groupBy(*keys).agg(F.count("*").alias("count"), F.count_distinct("_audio").alias("unique_audio_ids"))
    if strict_compat:
        return out.withColumn("unique_hashtags", F.size(F.array_distinct(F.split("feature", ""))).cast("long"))
    if not hashtags:
        return out.withColumn("unique_hashtags", F.lit(0).cast("long"))
    tags = one.select(*keys, F.explode("_tags").alias("tag")).groupBy(*keys).agg(F.count_distinct("tag").alias("unique_hashtags"))
    return out.join(tags, keys, "left").fillna(0, ["unique_hashtags"])


def with_trend(series: DataFrame, by: Sequence[str] = ("interval", "feature"), time: str = "time_bin", value: str = "count", span: int = 5) -> DataFrame:
    """Adds rolling_mean over the last ``span`` rows present and rate_of_change to the last row, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(time)
    before = F.lag(value).over(w)
    return series.withColumns({
        "rolling_mean": F.avg(value).over(w.rowsBetween(1 - span, 0)), "rate_of_change": F.coalesce(F.try_divide(F.col(value) - before, before), F.lit(0.0)),
    })


def derivatives(series: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Adds growth, the difference to the last row, and acceleration, the difference of that; null where there is none."""
    w = Window.partitionBy(*by).orderBy(time)
    grown = series.withColumn("growth", F.col(value) - F.lag(value).over(w))
    return grown.withColumn("acceleration", F.col("growth") - F.lag("growth").over(w))


def zero_filled(series: DataFrame, group: str, time: str, term: str, value: str, times: DataFrame | None = None) -> DataFrame:
    """Every term of a group at every time of the group; 0.0 where there is no row.

    The times are those of ``times`` (group, time), which also holds times without a term; without it, those of the series."""
    times, terms = (series if times is None else times).select(group, time).distinct(), series.select(group, term).distinct()
    grid = times.join(terms, group)
    return grid.join(series.select(group, time, term, value), [group, time, term], "left").fillna(0.0, [value])


def densified(series: DataFrame, by: Sequence[str], time: str, value: str, interval: str) -> DataFrame:
    """Rows for the bins that are absent between the first and the last of each series, with count 0."""
    ends = series.groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    step = "1 week" if interval == "1w" else INTERVALS[interval]
    grid = ends.select(*by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(time))
    return grid.join(series, [*by, time], "left").fillna(0, [value])


def forecast(last: DataFrame, start: str, rate: str, time: str, points: int = 12, default_rate: float = 0.02, noise_seed: int | None = None) -> DataFrame:
    """``points`` weekly values that grow by ``rate`` each week from ``start``, at the Sundays after ``time``; with a seed, 5 % noise."""
    step = F.explode(F.sequence(F.lit(1), F.lit(points)))
    out = last.withColumn("step", step)
    value = F.col(start) * F.pow(1 + F.coalesce(rate, F.lit(default_rate)), F.col("step"))
    if noise_seed is not None:
        value = value + F.randn(noise_seed) * 0.05 * value
    first = F.next_day(F.date_add(F.to_date(time), 6), "SUN")
    return out.withColumns({"value": F.greatest(value, F.lit(0.0)), "week": F.date_add(first, (F.col("step") - 1) * 7)})

"""Growth and decay states of series, by three rules that are kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import derivatives


def _false_if_null(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def decay_v1(series: DataFrame, by: Sequence[str] = ("feature",), time: str = "timestamp", value: str = "count", period: int = 3) -> DataFrame:
    """One row for each series of more than ``period`` rows: trend_state, decay_confidence, avg_growth, avg_acceleration, total_change, latest_growth, latest_acceleration.

    Looks at the last ``period`` differences. A null among the accelerations counts against decay, so a series of
    period + 1 rows is never 'Decaying'. Times must be unique in a series."""
    w = Window.partitionBy(*by)
    back = F.row_number().over(w.orderBy(F.desc(time)))
    long = derivatives(series.select(*by, time, value), by, time, value).withColumns({"_back": back, "_n": F.count("*").over(w)})
    long = long.filter(F.col("_n") > period)
    tail = F.col("_back") <= period
    g, a = F.col("growth"), F.col("acceleration")
    every = lambda test: F.bool_and(F.when(tail, _false_if_null(test)))
    out = long.groupBy(*by).agg(
        every(g > 0).alias("_up"), every(g < 0).alias("_down"), every(a < 0).alias("_slowing"),
        F.bool_or(tail & _false_if_null(a > 0)).alias("_faster"), F.count_if(tail & a.isNotNull()).alias("_known"),
        F.avg(F.when(tail, g)).alias("_g"), F.avg(F.when(tail, a)).alias("_a"),
        F.avg(g).alias("avg_growth"), F.avg(a).alias("avg_acceleration"),
        (F.max_by(value, time) - F.min_by(value, time)).alias("total_change"),
        F.max_by("growth", time).alias("latest_growth"), F.max_by("acceleration", time).alias("latest_acceleration"),
    )
    decaying = F.col("_up") & F.col("_slowing") & (F.col("_known") >= period - 1)
    state = F.when(decaying, "Decaying").when(F.col("_up") & F.col("_faster"), "Accelerating").when(F.col("_up"), "Growing").when(F.col("_down"), "Declining").otherwise("Stable")
    sure = F.when(decaying, F.least(F.lit(1.0), F.abs("_a") / F.greatest("_g", F.lit(0.001)))).otherwise(0.0)
    return out.withColumns({"trend_state": state, "decay_confidence": sure, "periods_analyzed": F.lit(period)}).select(
        *by, "trend_state", "decay_confidence", "avg_growth", "avg_acceleration", "total_change", "periods_analyzed", "latest_growth", "latest_acceleration"
    )


def decay_v1_enriched(rows: DataFrame, states: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """``rows`` with the state of their series; 'Unknown' and 0.0 where the series is too short."""
    joined = rows.join(states, list(by), "left")
    return joined.fillna("Unknown", ["trend_state"]).fillna(0.0, ["decay_confidence"])


def decay_v2(series: DataFrame, by: Sequence[str] = ("category", "term"), time: str = "window_start", value: str = "tfidf_score") -> DataFrame:
    """One row for each series: trend_state, decay_confidence, avg_growth_rate, avg_acceleration of its last three differences.

    Differences are rounded to 12 places before their signs are read. Fewer than four rows: 'Insufficient_Data', zeros."""
    w = Window.partitionBy(*by)
    d = derivatives(series.select(*by, time, value), by, time, value)
    d = d.withColumns({"growth": F.round("growth", 12), "acceleration": F.round("acceleration", 12), "_back": F.row_number().over(w.orderBy(F.desc(time))), "_n": F.count("*").over(w)})
    k = F.least(F.lit(3), F.col("_n") - 2)
    out = d.groupBy(*by, "_n").agg(
        F.round(F.avg(F.when(F.col("_back") <= 3, F.col("growth"))), 12).alias("_g"),
        F.round(F.avg(F.when(F.col("_back") <= k, F.col("acceleration"))), 12).alias("_a"),
        (F.count_if((F.col("_back") <= k) & (F.col("growth") > 0) & (F.col("acceleration") < 0)) / k).alias("_sure"),
    )
    g, a = F.col("_g"), F.col("_a")
    state = F.when((g > 0) & (a < 0), "Decaying").when((g > 0) & (a > 0), "Accelerating").when((g > 0) & (F.abs(a) < 0.01), "Growing").when(F.abs(g) < 0.01, "Stable").otherwise("Declining")
    long = F.col("_n") >= 4
    return out.select(
        *by, F.when(long, state).otherwise("Insufficient_Data").alias("trend_state"), F.when(long, F.col("_sure")).otherwise(0.0).alias("decay_confidence"),
        F.when(long, g).otherwise(0.0).alias("avg_growth_rate"), F.when(long, a).otherwise(0.0).alias("avg_acceleration"),
    )


def decay_v3(velocity: Column, acceleration: Column) -> Column:
    """The state by velocity and acceleration at one time; null if either is."""
    v, a = velocity, acceleration
    return F.when(v.isNull() | a.isNull(), F.lit(None).cast("string")).when((v > 0) & (a > 0), "Growing").when(v > 0, "Peaking").when(a < 0, "Decaying").otherwise("Stable")


def appearances(filled: DataFrame, by: Sequence[str] = ("category", "term"), time: str = "window_start", value: str = "tfidf_score", least: int = 5) -> DataFrame:
    """Figures of each zero-filled series with at least ``least`` non-zero rows."""
    return filled.groupBy(*by).agg(
        F.count_if(F.col(value) > 0).alias("appearances"), F.count("*").alias("total_windows"), F.max(value).alias("max_tfidf"),
        F.min(value).alias("min_tfidf"), F.max_by(value, time).alias("latest_tfidf"),
    ).filter(F.col("appearances") >= least)


STATES = ("Decaying", "Accelerating", "Growing", "Stable", "Declining")


def state_summary(states: DataFrame, group: str = "category") -> DataFrame:
    """Terms in each state for each group, all states present, and the share that decays in per cent."""
    counts = [F.count_if(F.col("trend_state") == s).alias(s.lower()) for s in STATES]
    out = states.groupBy(group).agg(F.count("*").alias("total_terms"), *counts)
    return out.withColumn("decay_percentage", F.try_divide(F.col("decaying") * 100.0, F.col("total_terms")))

"""The stages in one plan: posts to processed posts, feature series, candidates, weekly terms, lifecycle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lifecycle, standardise, tfidf, timeseries
from tidemark.session import cut, written

DEFAULTS = {
    "series": {"intervals": ["1h", "6h"], "features": ["hashtags", "tokens"]},
    "terms": {"weekly_top": 10, "least_posts": 50, "least_per_window": 5},
    "lifecycle": {"least_appearances": 5},
}


def merged(config: Mapping | None, defaults: Mapping = DEFAULTS) -> dict:
    """``config`` over the defaults, section by section."""
    out = dict(defaults)
    for key, value in (config or {}).items():
        out[key] = merged(value, out[key]) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def feature_series(processed: DataFrame, config: Mapping | None = None) -> DataFrame:
    """(feature_type, interval, time_bin, feature, count, ..., rolling_mean, rate_of_change) for hashtags and tokens."""
    settings = merged(config)["series"]
    out = None
    for kind in settings["features"]:
        counts = timeseries.feature_counts(processed, kind, "timestamp", settings["intervals"], hashtags="hashtags")
        one = timeseries.with_trend(counts).withColumn("feature_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def trend_candidates(series: DataFrame) -> DataFrame:
    """Rows of all intervals by time and, within a time, the fastest first."""
    return series.orderBy("time_bin", F.desc("rate_of_change"), "interval", "feature_type", "feature")


def weekly_posts(processed: DataFrame, config: Mapping | None = None) -> DataFrame:
    """The posts of each category with enough posts, with their window_start."""
    least = merged(config)["terms"]["least_posts"]
    enough = processed.groupBy("category").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("category")
    # One row for each listed category: a join on its few keys would send the posts to as few tasks.
    return processed.join(F.broadcast(enough), "category").withColumn("window_start", F.to_date(timeseries.time_bin(F.col("timestamp"), "1w")))


def weekly_terms(processed: DataFrame, doc: str, config: Mapping | None = None) -> DataFrame:
    """(category, window_start, term, tfidf_score, rank) of each category with enough posts."""
    settings = merged(config)["terms"]
    scores = tfidf.term_scores(weekly_posts(processed, config), ["category", "window_start"], doc, "text", least_docs=settings["least_per_window"])
    return tfidf.top_terms(scores, ["category", "window_start"], settings["weekly_top"])


def term_lifecycle(weekly: DataFrame, weeks: DataFrame, config: Mapping | None = None) -> DataFrame:
    """State and figures of each term with enough appearances over its category's ``weeks`` (category, window_start).

    Weeks with a post count even where no term was found in them."""
    filled = timeseries.zero_filled(weekly, "category", "window_start", "term", "tfidf_score", weeks)
    stats = lifecycle.appearances(filled, least=merged(config)["lifecycle"]["least_appearances"])
    return lifecycle.decay_v2(filled).join(stats, ["category", "term"])


STAGES = ("posts", "series", "candidates", "weekly_terms", "lifecycle")
#: Columns of posts that later stages read.
_SERIES, _TERMS = ["timestamp", "hashtags", "tokens"], ["category", "timestamp", "text", "post_key"]


def run(*raw: DataFrame, config: Mapping | None = None, wanted: Sequence[str] = STAGES) -> dict[str, DataFrame]:
    """The wanted stages from raw comment and video tables. Posts are written once to the checkpoint folder, with the columns
    that the wanted stages read; each row is a document of its own, also where a comment was delivered again."""
    processed = standardise.processed(standardise.posts(*raw)).withColumn("post_key", F.monotonically_increasing_id())
    if wanted and set(wanted) <= {"posts"}:
        return {"posts": processed}
    if "posts" not in wanted:
        needed = [*(_SERIES if {"series", "candidates"} & set(wanted) else []), *(_TERMS if {"weekly_terms", "lifecycle"} & set(wanted) else [])]
        processed = processed.select(*dict.fromkeys(needed))
    return after_posts(written(processed, "posts"), config, wanted)


def after_posts(processed: DataFrame, config: Mapping | None = None, wanted: Sequence[str] = STAGES) -> dict[str, DataFrame]:
    """The stages that read processed posts. Weekly terms, a few rows for each week, are written once."""
    stages = {"posts": processed}
    if {"series", "candidates"} & set(wanted):
        stages["series"] = feature_series(processed, config)
        stages["candidates"] = trend_candidates(stages["series"])
    if {"weekly_terms", "lifecycle"} & set(wanted):
        stages["weekly_terms"] = cut(weekly_terms(processed, "post_key", config))
        stages["lifecycle"] = term_lifecycle(stages["weekly_terms"], weekly_posts(processed, config), config)
    return {name: stages[name] for name in STAGES if name in wanted}

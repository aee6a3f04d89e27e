"""What a dashboard asks: leaderboards, facets, term search, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_word_term, term_name


def trend_rows(terms: DataFrame, category: str = "category", term: str = "term", score: str = "tfidf_score") -> DataFrame:
    """Leaderboard rows: trend_id, category in title case, trend_score (score x 1000, cut), sentiment_score (0.5 + score, at most 0.95)."""
    order = Window.partitionBy(category).orderBy(F.desc(F.round(score, 12)), term)
    return terms.select(
        F.row_number().over(order).alias("trend_id"), F.initcap(F.trim(F.col(category))).alias("category"), F.col(term).alias("term"),
        (F.col(score) * 1000).cast("int").alias("trend_score"), F.least(F.lit(0.95), 0.5 + F.col(score)).alias("sentiment_score"),
    )


def dashboard(rows: DataFrame) -> DataFrame:
    """The columns of leaderboard rows that are shown, under their headings."""
    return rows.select(F.col("term").alias("Trend"), F.col("category").alias("Category"), F.col("trend_score").alias("Score"), F.col("sentiment_score").alias("Sentiment"))


def facets(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that hold a wanted value in every named column; an empty list of values is no filter."""
    for name, values in wanted.items():
        if values:
            df = df.filter(F.col(name).isin(*values))
    return df


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group by an order that should settle all ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def all_terms(*sources: DataFrame) -> DataFrame:
    """Distinct terms of the sources' first columns that are words."""
    out = None
    for s in sources:
        one = s.select(F.col(s.columns[0]).alias("term"))
        out = one if out is None else out.unionByName(one)
    return out.filter(is_word_term(F.col("term"))).distinct()


def fuzzy_lookup(terms: DataFrame, wanted: str, category: str = "category", term: str = "term") -> DataFrame:
    """The best row of each category for a name: equal first, else one that holds the name or is held by it, by term.

    A filter with the name as a literal, not a join."""
    name = term_name(F.lit(wanted))
    own = term_name(F.col(term))
    hit = terms.filter((own != "") & (name != "") & (F.contains(own, name) | F.contains(name, own)))
    return top_k(hit.withColumn("exact", own == name), 1, [category], [F.desc("exact"), F.col(term)]).drop("rank")


def best_temporal_match(weekly: DataFrame, wanted: str, category: str = "category", window: str = "window_start", term: str = "term",
                        score: str = "tfidf_score", rank: str = "rank") -> DataFrame:
    """(category, windows, match_score) of the category in which the name scores most over all windows.

    In each window the first term by rank counts that holds the name or is held by it; else, at half its score, the
    first that shares a word of more than two characters. Scores are x 1000."""
    name, own = term_name(F.lit(wanted)), term_name(F.col(term))
    part = F.contains(own, name) | F.contains(name, own)
    words = lambda x: F.filter(F.split(x, " "), lambda w: F.length(w) > 2)
    shared = F.arrays_overlap(words(own), words(name))
    hit = weekly.withColumns({"_part": part, "_shared": shared}).filter((own != "") & (F.col("_part") | F.col("_shared")))
    first = top_k(hit, 1, [category, window], [F.desc("_part"), F.col(rank), F.col(term)], "_first")
    value = F.when(F.col("_part"), F.col(score)).otherwise(F.col(score) / 2) * 1000
    totals = first.groupBy(category).agg(F.count("*").alias("windows"), F.sum(value).alias("match_score"))
    return totals.orderBy(F.desc(F.round("match_score", 9)), category).limit(1)


def direction(first: Column, last: Column) -> Column:
    change = last - first
    return F.when(change > 0, "Growth").when(change < 0, "Decline").otherwise("Stable")


def coverage(appearances: Column, total: Column) -> Column:
    """Share of windows in per cent; 0 without windows."""
    return F.coalesce(F.try_divide(appearances * 100.0, total), F.lit(0.0))

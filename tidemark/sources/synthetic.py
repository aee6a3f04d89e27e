"""Made-up posts, the same on every run and on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPENINGS = ("trying a new", "my honest review of this", "day ten with the", "is anyone else using a", "unboxing the")
THINGS = ("serum #skincare", "lipstick #makeup", "hair mask #hair", "linen outfit #ootd", "sunscreen spf 50 #glow")
OTHER = ("the train was late again", "local news at nine", "our dog met a fox")


def drawn(key: Column, salt: str, seed: int) -> Column:
    """A number by the md5 of key, seed and salt, which any engine draws alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(salt))), 1, 7), 16, 10).cast("long")


def synthetic_posts(spark: SparkSession, rows: int = 100_000, seed: int = 7) -> DataFrame:
    """Comments of which each tenth is about nothing relevant."""
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (drawn(F.col("id"), salt, seed) % len(words) + 1).cast("int"))
    text = F.when(F.col("id") % 10 == 0, pick(OTHER, "o")).otherwise(F.concat_ws(" ", pick(OPENINGS, "a"), pick(THINGS, "b")))
    seconds = drawn(F.col("id"), "t", seed) % (30 * 86400)
    return spark.range(rows).select(
        F.concat(F.lit("c"), "id").alias("commentId"), F.lit(None).cast("string").alias("parentCommentId"), F.concat(F.lit("v"), (F.col("id") % 97).cast("string")).alias("videoId"),
        F.concat(F.lit("u"), (F.col("id") % 1009).cast("string")).alias("authorId"), text.alias("textOriginal"),
        (drawn(F.col("id"), "l", seed) % 500).alias("likeCount"), F.timestamp_seconds(F.lit(1704067200) + seconds).alias("publishedAt"),
    )


def seeded_history(spark: SparkSession, term: str, weeks: int = 12, seed: int = 7) -> DataFrame:
    """(window_start, term, value): a stand-in history for a term without one."""
    value = 20 + (drawn(F.col("id"), term, seed) % 60).cast("double") + F.col("id") * 2
    return spark.range(weeks).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7).cast("int")).alias("window_start"), F.lit(term).alias("term"), value.alias("value"))

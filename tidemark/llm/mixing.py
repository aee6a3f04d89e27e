"""Problem 7: sources mixed so that each takes its target share of all tokens.

Method: tokens are summed for each source; with t the tokens a source has, s its target share and m its most
repeats, the mixture can be at most T = min(m t / s) tokens, and a source's repetition rate is s T / t, never
above m. Each document is emitted floor(rate) times, and once more with the probability of the fraction by a
hash of its id and the seed, so a rerun or a lost executor gives the same mixture.

Scale: one pass tokenises; what is kept of it, an id, a source and a size, is written to the checkpoint folder.
The table of rates has one row for each listed source (bounded, checked) and is broadcast; no document is shuffled.

Defined results: sources are compared without case and outer blanks; documents of a null or unlisted source and
documents without tokens are left out; a listed source without tokens is reported with share 0 and the other
targets are scaled up to 1; a source listed twice counts by its largest target; repeats that are null count as
1, targets that are null or not above 0 as none; repeated documents are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKENIZER, with_token_counts
from tidemark.session import cut

SEED = 17
#: Most sources in a list of weights; the rates are broadcast.
MOST_SOURCES = 100_000


def source_key(name: str):
    return F.lower(F.trim(F.regexp_replace(F.col(name), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), tokenised once and kept in the checkpoint folder."""
    keep = {"doc_id": F.col(id_col), "source": source_key(source_col)}
    return cut(with_token_counts(docs, text_col, keep, path).filter("n_tokens > 0 and source is not null"))


def rates(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, documents, rate) for each listed source."""
    listed = weights.select(
        source_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"),
    ).filter("source is not null and target_share > 0")
    listed = listed.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    if listed.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    both = listed.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    full = both.agg(
        F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("t")
    ).scalar()
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * full / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("rate", F.round(rate, 9))


def mixture(sizes: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no): one row for each use of a document."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate").cast("int")
    copies = whole + (chance < F.col("rate") - whole).cast("int")
    placed = sizes.join(F.broadcast(rated.select("source", "rate")), "source").withColumn("copies", copies).filter("copies > 0")
    return placed.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))


def shares(rated: DataFrame, mixed: DataFrame) -> DataFrame:
    """What each listed source was to take, has, and took."""
    took = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("copy_no").alias("most_copies"), F.count("*").alias("used_documents"))
    every = took.agg(F.sum("used_tokens").alias("n")).scalar()
    out = rated.join(took, "source", "left").fillna(0, ["used_tokens", "most_copies", "used_documents"])
    return out.select(
        "source", "target_share", "max_repeats", "documents", "tokens", "rate", "used_documents", "used_tokens", "most_copies",
        F.coalesce(F.col("used_tokens") / every, F.lit(0.0)).alias("actual_share"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sizes, rates(sizes, spark.read.parquet(f"{sf_dir}/source_weights.parquet"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rated = _inputs(spark, sf_dir)
    return mixture(sizes, rated)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rated = _inputs(spark, sf_dir)
    return shares(rated, mixture(sizes, rated))

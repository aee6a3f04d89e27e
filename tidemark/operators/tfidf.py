"""Grouped TF-IDF over words and pairs of words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.text import term_clean
from tidemark.session import written


def term_scores(docs: DataFrame, part: Sequence[str], doc: str, text: str, least_docs: int = 5, min_df: int = 2, max_df: float = 0.8,
                max_terms: int = 1000, stop_words: Iterable[str] = tuple(L.STOP_WORDS)) -> DataFrame:
    """(part.., term, tfidf_score, df, docs): mean TF-IDF of each kept term over all documents of its part.

    Texts of more than ten characters count; parts of fewer than ``least_docs`` of them have no terms. Pairs join
    neighbours of the filtered words. Of the terms in min_df documents and no more than max_df of them the
    ``max_terms`` most frequent are kept, ties by term. Rows are scaled to length 1 over the kept terms.

    Words are exploded before stop words are taken out and pairs come from ``lead``, so that no array expression is
    evaluated again for each element. Everything runs for all parts at once, by keys. The counts of terms in documents are
    written once to the checkpoint folder; terms, weights and norms read them there."""
    part = list(part)
    keyed = docs.select(*part, F.col(doc).alias("_doc"), F.col(text).alias("_text")).filter(F.length(F.trim("_text")) > 10)
    sizes = keyed.groupBy(*part).agg(F.count_distinct("_doc").alias("_n")).filter(F.col("_n") >= least_docs)
    words = F.regexp_extract_all(term_clean(F.col("_text")), F.lit(L.TERM_TOKEN), F.lit(0))
    placed = keyed.select(*part, "_doc", F.posexplode(words).alias("_pos", "_word")).filter(~F.col("_word").isin(*stop_words))
    w = Window.partitionBy(*part, "_doc").orderBy("_pos")
    pairs = placed.withColumn("_next", F.lead("_word").over(w))
    both = F.when(F.col("_next").isNotNull(), F.array("_word", F.concat_ws(" ", "_word", "_next"))).otherwise(F.array("_word"))
    tf = pairs.select(*part, "_doc", F.explode(both).alias("term")).groupBy(*part, "_doc", "term").agg(F.count("*").alias("_tf"))
    tf = written(tf, "tf")
    terms = tf.groupBy(*part, "term").agg(F.count("*").alias("df"), F.sum("_tf").alias("_total"))
    terms = terms.join(sizes, part).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("_total"), "term"))
    kept = terms.withColumn("_rank", rank).filter(F.col("_rank") <= max_terms)
    kept = kept.withColumn("_idf", F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)
    weighed = tf.join(kept.drop("_total", "_rank"), [*part, "term"]).withColumn("_w", F.col("_tf") * F.col("_idf"))
    norms = weighed.groupBy(*part, "_doc").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    scored = weighed.join(norms, [*part, "_doc"])
    return scored.groupBy(*part, "term").agg(
        (F.sum(F.col("_w") / F.col("_norm")) / F.first("_n")).alias("tfidf_score"), F.first("df").alias("df"), F.first("_n").alias("docs")
    )


def top_terms(scores: DataFrame, part: Sequence[str], n: int) -> DataFrame:
    """The n best terms of each part with their rank; scores equal at 12 places go by term."""
    w = Window.partitionBy(*part).orderBy(F.desc(F.round("tfidf_score", 12)), "term")
    return scores.filter("tfidf_score > 0").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)

"""Vocabularies of features: counts, spelling, language, translation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import lexicon as L
from tidemark.functions.text import keyword_hits

# Words by which the default language vote goes.
VOTES = {
    "en": ["the", "and", "for", "with", "this"], "es": ["el", "los", "para", "con", "una"], "fr": ["le", "les", "pour", "avec", "une"],
    "de": ["der", "die", "und", "mit", "das"],
}
#: Words in a mapping dictionary that may be broadcast.
MOST_WORDS = 200_000
#: Rows from which a term of a table counts as a known word.
KNOWN_ROWS = 20


def hashtag_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(feature, count, type): tags with '#' in lower case, every occurrence counted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(L.HASHTAG), F.lit(0))
    return texts.select(F.explode(found).alias("feature")).groupBy("feature").agg(F.count("*").alias("count")).withColumn("type", F.lit("hashtag"))


def keyword_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(feature, count, type): keywords, once for each text."""
    return texts.select(F.explode(keyword_hits(F.col(text))).alias("feature")).groupBy("feature").agg(F.count("*").alias("count")).withColumn("type", F.lit("keyword"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def known_words(terms: DataFrame, term: str, least: int = KNOWN_ROWS) -> DataFrame:
    """(word, count): the trimmed lower-case terms that at least ``least`` rows hold."""
    return terms.groupBy(F.lower(F.trim(F.col(term))).alias("word")).agg(F.count("*").alias("count")).filter((F.col("word") != "") & (F.col("count") >= least))


def _shortened(word: Column, most: int) -> Column:
    """The word and what is left of it without up to ``most`` letters. Words within ``most`` edits share one of these."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    out = F.array(word)
    for _ in range(most):
        out = F.array_union(out, F.flatten(F.transform(out, without)))
    return out


def corrected(terms: DataFrame, term: str, words: Mapping[str, str] = L.SPELLING, vocabulary: DataFrame | None = None, distance: int = 1) -> DataFrame:
    """Adds corrected, was_corrected, method and changed.

    A dictionary hit on the trimmed lower-case term counts as corrected even where the word stays the same. Others
    stay as they are, trimmed; with ``vocabulary`` (word, count) those that aren't in it take its nearest word within
    ``distance`` edits, the most frequent first, then by alphabet. Misspellings of the dictionary are no such words."""
    spark = terms.sparkSession
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in the dictionary")
    table = F.broadcast(spark.createDataFrame(sorted(words.items()), "_key string, _word string"))
    low = F.lower(F.trim(F.col(term)))
    out = terms.withColumn("_key", low).join(table, "_key", "left")
    word, method = F.coalesce("_word", F.trim(F.col(term))), F.when(F.col("_word").isNotNull(), "dictionary")
    if vocabulary is not None:
        own = out.filter("_word is null and _key <> ''").select("_key").distinct().withColumn("_part", F.explode(_shortened(F.col("_key"), distance)))
        known = vocabulary.groupBy(F.lower(F.trim("word")).alias("_near")).agg(F.sum("count").alias("_count")).filter("_near <> ''")
        known = known.join(table.filter("_key <> _word"), F.col("_near") == F.col("_key"), "left_anti")
        near = own.join(known.withColumn("_part", F.explode(_shortened(F.col("_near"), distance))), "_part")
        near = near.withColumn("_d", F.levenshtein("_key", "_near")).filter(F.col("_d") <= distance)
        near = near.groupBy("_key").agg(F.min_by("_near", F.struct("_d", (-F.col("_count")).alias("c"), "_near")).alias("_near")).filter("_near <> _key")
        out = out.join(near, "_key", "left")
        word = F.coalesce("_word", "_near", F.trim(F.col(term)))
        method = F.coalesce(method, F.when(F.col("_near").isNotNull(), "nearest"))
    out = out.withColumns({"corrected": word, "was_corrected": method.isNotNull(), "method": F.coalesce(method, F.lit("none"))})
    return out.withColumn("changed", F.col("corrected") != F.col(term)).drop("_key", "_word", "_near")


def language(term: Column) -> Column:
    """struct(language, confidence) by votes of frequent words; 'en' without votes, ('unknown', 0) for a blank term.

    Confidence is length / 20 within 0.5 and 0.9."""
    low = F.split(F.lower(F.trim(term)), r"\s+")
    votes = {lang: F.size(F.array_intersect(low, F.array(*[F.lit(w) for w in ws]))) for lang, ws in VOTES.items()}
    top = F.greatest(*votes.values())
    name = F.lit("en")
    for lang, v in reversed(votes.items()):
        name = F.when((v == top) & (top > 0), lang).otherwise(name)
    blank = F.coalesce(F.trim(term), F.lit("")) == ""
    sure = F.least(F.lit(0.9), F.greatest(F.lit(0.5), F.length(F.trim(term)) / 20.0))
    return F.struct(F.when(blank, "unknown").otherwise(name).alias("language"), F.when(blank, 0.0).otherwise(sure).alias("confidence"))


def processed_terms(terms: DataFrame, term: str, translations: DataFrame | None = None, words: Mapping[str, str] = L.SPELLING,
                    detect: Callable[[Column], Column] = language, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row for each distinct non-null term: original_term, processed_term, spelling_corrected, spelling_method, translated, source_language, language_confidence, is_english, processing_steps.

    Terms of another language with confidence 0.7 or more are looked up in ``translations`` (term, translation).
    ``vocabulary`` as in ``corrected``."""
    distinct = terms.select(F.col(term).alias("original_term")).filter("original_term is not null").distinct()
    out = corrected(distinct, "original_term", words, vocabulary).withColumn("_lang", detect(F.col("corrected")))
    out = out.withColumns({"source_language": F.col("_lang.language"), "language_confidence": F.col("_lang.confidence")})
    out = out.withColumn("is_english", F.col("source_language") == "en")
    foreign = ~F.col("is_english") & (F.col("source_language") != "unknown") & (F.col("language_confidence") >= 0.7)
    if translations is None:
        out = out.withColumn("_translation", F.lit(None).cast("string"))
    else:
        table = translations.select(F.lower("term").alias("_t"), F.col("translation").alias("_translation")).dropDuplicates(["_t"])
        out = out.join(table, F.lower("corrected") == F.col("_t"), "left").drop("_t")
    translated = foreign & F.col("_translation").isNotNull()
    steps = F.array_compact(F.array(F.when(F.col("was_corrected"), "spelling"), F.lit("language"), F.when(translated, "translation")))
    return out.select(
        "original_term", F.when(translated, F.col("_translation")).otherwise(F.col("corrected")).alias("processed_term"),
        F.col("was_corrected").alias("spelling_corrected"), F.col("method").alias("spelling_method"), translated.alias("translated"),
        "source_language", "language_confidence", "is_english", steps.alias("processing_steps"),
    )


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Adds <column>_original, <column>_processed and <column>_was_corrected; the mapping has one row for each distinct value."""
    table = mapping.select(F.col("original_term").alias("_key"), F.col("processed_term").alias("_to"), F.col("spelling_corrected").alias("_hit"))
    out = df.join(table, df[column] == F.col("_key"), "left")
    return out.withColumns({
        f"{column}_original": F.col(column), f"{column}_processed": F.coalesce("_to", F.col(column)), f"{column}_was_corrected": F.coalesce("_hit", F.lit(False)),
    }).drop("_key", "_to", "_hit")


def processing_rates(processed: DataFrame) -> DataFrame:
    """Counts and rates in per cent of corrected, translated and English terms."""
    n = F.count("*")
    rate = lambda c: F.count_if(F.col(c)) * 100.0 / F.greatest(n, F.lit(1))
    return processed.agg(n.alias("terms"), *[rate(c).alias(f"{c}_rate") for c in ("spelling_corrected", "translated", "is_english")])

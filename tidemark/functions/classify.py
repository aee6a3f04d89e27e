"""Rule classifiers as expressions; a null text is read as ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.text import any_of


def category(cleaned: Column) -> Column:
    """The first category, in listed order, with a word in the text; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(L.CATEGORY_KEYWORDS.items()):
        out = F.when(F.lower(cleaned).rlike(any_of(words)), name).otherwise(out)
    return out


def _held(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def rule_category(text: Column) -> Column:
    """struct(category, confidence): the largest share of a category's words; ties go to the one listed first."""
    scores = {name: _held(text, words) / F.lit(float(len(words))) for name, words in L.RULE_CATEGORIES.items()}
    top = F.greatest(*scores.values())
    name = F.lit("lifestyle")
    for c, s in reversed(scores.items()):
        name = F.when(s == top, c).otherwise(name)
    return F.struct(
        F.when(top > 0, name).otherwise("lifestyle").alias("category"), F.when(top > 0, top).otherwise(0.1).alias("confidence")
    )


def rule_sentiment(text: Column) -> Column:
    """struct(sentiment, confidence, score) by the words held; a tie is neutral."""
    good, bad = _held(text, L.POSITIVE), _held(text, L.NEGATIVE)
    best = F.least(F.greatest(good, bad) / 10.0, F.lit(1.0))
    return F.struct(
        F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral").alias("sentiment"),
        F.when(good != bad, best).otherwise(0.5).alias("confidence"),
        F.when(good > bad, best).when(bad > good, -best).otherwise(0.0).alias("score"),
    )


def age_group(text: Column) -> Column:
    """struct(age_group, confidence): the first keyword of the cascade, overridden by the mean of stated ages.

    A null text is 'unknown' with confidence 0."""
    low = F.lower(text)
    name, sure = F.lit("unknown"), F.lit(0.0)
    for group, conf, words in reversed(L.AGE_CASCADE):
        hit = low.rlike(any_of(words))
        name, sure = F.when(hit, group).otherwise(name), F.when(hit, conf).otherwise(sure)
    stated = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in L.AGES])
    ages = F.transform(stated, lambda x: x.cast("int"))
    mean = F.aggregate(ages, F.lit(0.0), lambda a, x: a + x) / F.size(ages)
    by_age = F.lit("boomer")
    for limit, group in reversed(L.AGE_LIMITS):
        by_age = F.when(mean <= limit, group).otherwise(by_age)
    named = F.coalesce(F.size(ages) > 0, F.lit(False))
    return F.struct(F.when(named, by_age).otherwise(name).alias("age_group"), F.when(named, 0.9).otherwise(sure).alias("confidence"))


def age_indicators(text: Column) -> Column:
    """struct(age_group, confidence, indicators, numeric_ages): all that the patterns find, in their order.

    A stated age with its unit is one indicator ("19 yo"). A null text has none and is 'unknown' with confidence 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda p, k: F.regexp_extract_all(low, F.lit(p), F.lit(k))
    first, *others = L.AGE_PATTERNS
    stated = F.zip_with(found(first, 1), found(first, 2), lambda n, unit: F.concat_ws(" ", n, unit))
    group = age_group(text)
    return F.struct(
        group["age_group"].alias("age_group"), group["confidence"].alias("confidence"),
        F.concat(stated, *[found(p, 1) for p in others]).alias("indicators"),
        F.transform(F.concat(found(first, 1), found(others[0], 1)), lambda n: n.cast("int")).alias("numeric_ages"),
    )

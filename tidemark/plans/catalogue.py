"""All queries over the test tables, with the SQL that gives the same rows. Times come out as text, scores rounded."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify, hooks, text
from tidemark.functions import lexicon as L
from tidemark.operators import lifecycle, lookup, semantic, standardise, tfidf, timeseries, vocabulary
from tidemark.plans import pipeline
from tidemark.plans import sql as S
from tidemark.session import cut
from tidemark.sources import files, synthetic
from tidemark.sources.tables import table
from tidemark.streaming import bins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Numbers in a vector of the test tables.
VECTOR = 64


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return standardise.standardise_comments(table(spark, d, "comments"))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return standardise.standardise_videos(table(spark, d, "videos"))


def _processed(spark: SparkSession, d: str) -> DataFrame:
    return standardise.processed(standardise.posts(table(spark, d, "comments"), table(spark, d, "videos")))


# Standardisation

@query("q_standardise_comments", f"WITH {S.COMMENTS} SELECT commentId, videoId AS video_id, authorId AS author_id, {S.stamp('ts')} AS ts, txt AS text, engagement AS engagement_score, reply AS is_reply FROM comments_std")
def q_standardise_comments(spark, d):
    return _comments(spark, d).select("commentId", "video_id", "author_id", _stamp("timestamp").alias("ts"), "text", "engagement_score", "is_reply")


@query("q_standardise_videos", f"WITH {S.VIDEOS} SELECT videoId AS video_id, channelId AS channel_id, {S.stamp('ts')} AS ts, txt AS text, round(engagement, 6) AS engagement_score, contentDuration AS content_duration FROM videos_std")
def q_standardise_videos(spark, d):
    return _videos(spark, d).select("video_id", "channel_id", _stamp("timestamp").alias("ts"), "text", _r("engagement_score").alias("engagement_score"), "content_duration")


@query("q_engagement", f"WITH {S.VIDEOS} SELECT channelId AS channel_id, count(*) AS videos, round(sum(engagement), 4) AS engagement, round(max(engagement), 4) AS best FROM videos_std GROUP BY 1")
def q_engagement(spark, d):
    return _videos(spark, d).groupBy("channel_id").agg(F.count("*").alias("videos"), _r(F.sum("engagement_score"), 4).alias("engagement"), _r(F.max("engagement_score"), 4).alias("best"))


@query("q_process_posts", f"WITH {S.POSTS} SELECT dataset_type, video_id, {S.stamp('ts')} AS ts, cleaned AS cleaned_text, category, round(engagement, 6) AS engagement_score FROM processed")
def q_process_posts(spark, d):
    return _processed(spark, d).select("dataset_type", "video_id", _stamp("timestamp").alias("ts"), "cleaned_text", "category", _r("engagement_score").alias("engagement_score"))


# Text

@query("q_relevance_filter", f"SELECT commentId, textOriginal AS text FROM comments WHERE {S.holds('lower(textOriginal)', S.ALL_KEYWORDS)}")
def q_relevance_filter(spark, d):
    return table(spark, d, "comments").filter(text.relevant(F.col("textOriginal"))).select("commentId", F.col("textOriginal").alias("text"))


@query("q_clean_text", f"SELECT commentId, {S.clean('textOriginal')} AS cleaned FROM comments")
def q_clean_text(spark, d):
    return table(spark, d, "comments").select("commentId", text.clean(F.col("textOriginal")).alias("cleaned"))


@query("q_clean_documents", f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def q_clean_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("q_emoji_strip", f"SELECT doc_id, {S.replaced('coalesce(text, ' + S.text('') + ')', L.EMOJI)} AS stripped FROM documents")
def q_emoji_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_emoji(F.col("text")).alias("stripped"))


@query("q_tfidf_preclean", f"SELECT commentId, regexp_replace(regexp_replace(lower(textOriginal), {S.text(L.TERM_NOISE)}, '', 'g'), {S.text(L.TERM_SPECIAL)}, ' ', 'g') AS bare FROM comments")
def q_tfidf_preclean(spark, d):
    return table(spark, d, "comments").select("commentId", text.term_clean(F.col("textOriginal")).alias("bare"))


@query("q_hashtags", f"SELECT commentId, lower(unnest(regexp_extract_all(textOriginal, {S.text(L.HASHTAG)}, 1))) AS tag FROM comments")
def q_hashtags(spark, d):
    return table(spark, d, "comments").select("commentId", F.explode(text.hashtags(F.col("textOriginal"))).alias("tag"))


@query("q_hashtag_vocab", f"SELECT feature, count(*) AS count, 'hashtag' AS type FROM (SELECT unnest(regexp_extract_all(lower(textOriginal), {S.text(L.HASHTAG)}, 0)) AS feature FROM comments) GROUP BY 1")
def q_hashtag_vocab(spark, d):
    return vocabulary.hashtag_vocabulary(table(spark, d, "comments"), "textOriginal")


@query("q_keyword_vocab", "SELECT feature, count(*) AS count, 'keyword' AS type FROM comments JOIN (SELECT unnest([" + S.in_list(L.VOCABULARY_KEYWORDS) + "]) AS feature) ON contains(lower(textOriginal), feature) GROUP BY 1")
def q_keyword_vocab(spark, d):
    return vocabulary.keyword_vocabulary(table(spark, d, "comments"), "textOriginal")


_WORDS = f"SELECT commentId, unnest(string_split({S.clean('textOriginal')}, ' ')) AS token FROM comments"


@query("q_tokens", f"SELECT commentId, token FROM ({_WORDS}) WHERE length(token) > 2 AND token NOT IN ({S.in_list(L.STOP_WORDS)})")
def q_tokens(spark, d):
    return table(spark, d, "comments").select("commentId", F.explode(text.tokens(text.clean(F.col("textOriginal")))).alias("token"))


@query("q_token_counts", f"SELECT token, count(*) AS count FROM ({_WORDS}) WHERE length(token) > 2 AND token NOT IN ({S.in_list(L.STOP_WORDS)}) GROUP BY 1")
def q_token_counts(spark, d):
    return q_tokens(spark, d).groupBy("token").agg(F.count("*").alias("count"))


# Classification

@query("q_category_first_match", f"SELECT post_id, {S.category('cleaned_text')} AS rule_category FROM processed_posts")
def q_category_first_match(spark, d):
    return table(spark, d, "processed_posts").select("post_id", classify.category(F.col("cleaned_text")).alias("rule_category"))


@query("q_category_counts", f"SELECT rule_category, count(*) AS posts FROM (SELECT {S.category('cleaned_text')} AS rule_category FROM processed_posts) WHERE rule_category IS NOT NULL GROUP BY 1")
def q_category_counts(spark, d):
    return vocabulary.value_counts(q_category_first_match(spark, d), "rule_category").withColumnRenamed("count", "posts")


_RULE = {c: f"{S.held('t', ws)} / CAST({len(ws)} AS DOUBLE)" for c, ws in L.RULE_CATEGORIES.items()}
_RULE_TOP = f"greatest({', '.join(_RULE.values())})"


@query("q_rule_category", f"SELECT post_id, CASE WHEN {_RULE_TOP} <= 0 THEN 'lifestyle' " + " ".join(f"WHEN {v} = {_RULE_TOP} THEN '{c}'" for c, v in _RULE.items()) + f" END AS category, round(CASE WHEN {_RULE_TOP} <= 0 THEN 0.1 ELSE {_RULE_TOP} END, 6) AS confidence FROM (SELECT post_id, lower(coalesce(text, '')) AS t FROM processed_posts)")
def q_rule_category(spark, d):
    got = table(spark, d, "processed_posts").select("post_id", classify.rule_category(F.col("text")).alias("x"))
    return got.select("post_id", "x.category", _r("x.confidence").alias("confidence"))


@query("q_rule_sentiment", f"SELECT commentId, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN p = n THEN 0.5 ELSE least(greatest(p, n) / CAST(10 AS DOUBLE), 1) END AS confidence, CASE WHEN p > n THEN least(p / CAST(10 AS DOUBLE), 1) WHEN n > p THEN -least(n / CAST(10 AS DOUBLE), 1) ELSE 0 END AS score FROM (SELECT commentId, {S.held('t', L.POSITIVE)} AS p, {S.held('t', L.NEGATIVE)} AS n FROM (SELECT commentId, lower(coalesce(textOriginal, '')) AS t FROM comments))")
def q_rule_sentiment(spark, d):
    return table(spark, d, "comments").select("commentId", classify.rule_sentiment(F.col("textOriginal")).alias("x")).select("commentId", "x.*")


_BIOS = ["19 yo skincare addict", "age 45, mother of two", "Gen Z and proud", "college student, 17 years old", "millennial mum", "sixteen going on thirty", "boomer with a blog", "Gen X painter", "no hints here", "80 yo and glowing"]


@query("q_age_group", "WITH bios AS (SELECT unnest([" + S.in_list(_BIOS) + "]) AS bio UNION ALL SELECT textOriginal FROM comments WHERE textOriginal IS NOT NULL) SELECT bio, age_group, count(*) AS texts FROM (SELECT bio, " + S.age("bio") + " AS age_group FROM bios) GROUP BY 1, 2")
def q_age_group(spark, d):
    bios = spark.createDataFrame([(b,) for b in _BIOS], "bio string").unionByName(table(spark, d, "comments").select(F.col("textOriginal").alias("bio")).filter("bio is not null"))
    return bios.select("bio", classify.age_group(F.col("bio"))["age_group"].alias("age_group")).groupBy("bio", "age_group").agg(F.count("*").alias("texts"))


@query("q_age_indicators", "WITH bios AS (SELECT unnest([" + S.in_list(_BIOS) + "]) AS bio UNION ALL SELECT textOriginal FROM comments WHERE textOriginal IS NOT NULL), a AS (SELECT bio, " + S.age("bio") + " AS age_group, " + S.indicators("bio") + " AS found, " + S.numbers("bio") + " AS ages FROM bios) SELECT bio, age_group, array_to_string(found, '|') AS indicators, array_to_string(ages, '|') AS numeric_ages, count(*) AS texts FROM a GROUP BY ALL")
def q_age_indicators(spark, d):
    """All ten patterns with what each finds."""
    bios = spark.createDataFrame([(b,) for b in _BIOS], "bio string").unionByName(table(spark, d, "comments").select(F.col("textOriginal").alias("bio")).filter("bio is not null"))
    got = bios.select("bio", classify.age_indicators(F.col("bio")).alias("x"))
    got = got.select("bio", "x.age_group", F.concat_ws("|", "x.indicators").alias("indicators"), F.concat_ws("|", F.transform("x.numeric_ages", lambda n: n.cast("string"))).alias("numeric_ages"))
    return got.groupBy("bio", "age_group", "indicators", "numeric_ages").agg(F.count("*").alias("texts"))


@query("q_post_columns", f"WITH {S.COMMENTS}, {S.VIDEOS} SELECT 'comments' AS dataset_type, videoId AS video_id, authorId AS author_id, NULL AS channel_id, reply AS is_reply, NULL AS content_duration, NULL AS topic_categories FROM comments_std UNION ALL SELECT 'videos', videoId, NULL, channelId, NULL, contentDuration, topicCategories FROM videos_std")
def q_post_columns(spark, d):
    posts = standardise.posts(table(spark, d, "comments"), table(spark, d, "videos"))
    return posts.select("dataset_type", "video_id", "author_id", "channel_id", "is_reply", "content_duration", "topic_categories")


# Time series

def _series(spark: SparkSession, d: str, interval: str) -> DataFrame:
    counts = timeseries.feature_counts(_processed(spark, d), "hashtags", "timestamp", [interval], audio="video_id", hashtags="hashtags")
    return timeseries.with_trend(counts)


for _i in ("1h", "6h", "1d", "1w"):
    @query(f"q_timebin_{_i}", f"WITH {S.TAGGED} SELECT {S.stamp(S.time_bin(_i))} AS time_bin, feature, count(*) AS count, count(DISTINCT video_id) AS unique_audio_ids FROM tagged GROUP BY 1, 2")
    def _timebin(spark, d, i=_i):
        counts = timeseries.feature_counts(_processed(spark, d), "hashtags", "timestamp", [i], audio="video_id")
        return counts.select(_stamp("time_bin").alias("time_bin"), "feature", "count", "unique_audio_ids")


@query("q_unique_hashtags_per_bin", f"WITH {S.TAGGED} SELECT {S.stamp(S.time_bin('1d', 'a.ts'))} AS time_bin, a.feature, count(DISTINCT b.feature) AS unique_hashtags FROM tagged a JOIN tagged b ON a.k = b.k GROUP BY 1, 2")
def q_unique_hashtags_per_bin(spark, d):
    return _series(spark, d, "1d").select(_stamp("time_bin").alias("time_bin"), "feature", "unique_hashtags")


@query("q_rolling_mean", f"WITH {S.series('1d')} SELECT {S.stamp('b')} AS time_bin, feature, n AS count, round(rolling_mean, 6) AS rolling_mean FROM trend")
def q_rolling_mean(spark, d):
    return _series(spark, d, "1d").select(_stamp("time_bin").alias("time_bin"), "feature", "count", _r("rolling_mean").alias("rolling_mean"))


@query("q_rate_of_change", f"WITH {S.series('6h')} SELECT {S.stamp('b')} AS time_bin, feature, n AS count, round(rate, 6) AS rate_of_change FROM trend")
def q_rate_of_change(spark, d):
    return _series(spark, d, "6h").select(_stamp("time_bin").alias("time_bin"), "feature", "count", _r("rate_of_change").alias("rate_of_change"))


def _union_series(i: str) -> str:
    return f"SELECT '{i}' AS interval, b, feature, n, coalesce(CAST(n - lag(n) OVER (PARTITION BY feature ORDER BY b) AS DOUBLE) / lag(n) OVER (PARTITION BY feature ORDER BY b), 0) AS rate FROM (SELECT {S.time_bin(i)} AS b, feature, count(*) AS n FROM tagged GROUP BY 1, 2)"


@query("q_trend_candidates", f"WITH {S.TAGGED}, both_ AS ({_union_series('1h')} UNION ALL {_union_series('6h')}) SELECT interval, {S.stamp('b')} AS time_bin, feature, n AS count, round(rate, 6) AS rate_of_change FROM both_")
def q_trend_candidates(spark, d):
    counts = timeseries.feature_counts(_processed(spark, d), "hashtags", "timestamp", ["1h", "6h"])
    return timeseries.with_trend(counts).select("interval", _stamp("time_bin").alias("time_bin"), "feature", "count", _r("rate_of_change").alias("rate_of_change"))


@query("q_top_growth", f"WITH {S.series('1d')} SELECT {S.stamp('b')} AS time_bin, feature, n AS count, round(rate, 6) AS rate_of_change, rank FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY rate DESC, feature) AS rank FROM trend) WHERE rank <= 5")
def q_top_growth(spark, d):
    top = lookup.top_k(_series(spark, d, "1d"), 5, ["time_bin"], [F.desc("rate_of_change"), F.col("feature")])
    return top.select(_stamp("time_bin").alias("time_bin"), "feature", "count", _r("rate_of_change").alias("rate_of_change"), "rank")


@query("q_category_of_feature", f"WITH {S.POSTS}, t AS (SELECT ts, txt, category, lower(unnest(regexp_extract_all(txt, {S.text(L.HASHTAG)}, 1))) AS feature FROM numbered), f AS (SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY ts, txt, category) AS r FROM t) SELECT feature, category FROM f WHERE r = 1")
def q_category_of_feature(spark, d):
    tags = _processed(spark, d).select("timestamp", "text", "category", F.explode("hashtags").alias("feature"))
    return tags.groupBy("feature").agg(F.min_by("category", F.struct("timestamp", "text", "category")).alias("category"))


# Lifecycle

def _event_bins(spark: SparkSession, d: str, interval: str = "1d") -> DataFrame:
    counts = timeseries.feature_counts(table(spark, d, "events"), "event_type", "ts", [interval])
    return counts.select("feature", F.col("time_bin").alias("timestamp"), "count")


@query("q_derivatives", f"WITH {S.EVENTS} SELECT feature, {S.stamp('b')} AS ts, n AS count, g AS growth, a AS acceleration FROM diffs")
def q_derivatives(spark, d):
    return timeseries.derivatives(_event_bins(spark, d), ["feature"], "timestamp", "count").select("feature", _stamp("timestamp").alias("ts"), "count", "growth", "acceleration")


@query("q_decay_v1", f"WITH {S.EVENTS} SELECT feature, trend_state, round(decay_confidence, 6) AS decay_confidence, round(avg_growth, 6) AS avg_growth, round(avg_acceleration, 6) AS avg_acceleration, total_change, latest_growth, latest_acceleration FROM states")
def q_decay_v1(spark, d):
    got = lifecycle.decay_v1(_event_bins(spark, d))
    return got.select("feature", "trend_state", *[_r(c).alias(c) for c in ("decay_confidence", "avg_growth", "avg_acceleration")], "total_change", "latest_growth", "latest_acceleration")


@query("q_decay_v1_enriched", f"WITH {S.EVENTS} SELECT feature, {S.stamp('b')} AS ts, n AS count, coalesce(trend_state, 'Unknown') AS trend_state, round(coalesce(decay_confidence, 0), 6) AS decay_confidence FROM binned LEFT JOIN states USING (feature)")
def q_decay_v1_enriched(spark, d):
    rows = _event_bins(spark, d)
    got = lifecycle.decay_v1_enriched(rows, lifecycle.decay_v1(rows))
    return got.select("feature", _stamp("timestamp").alias("ts"), "count", "trend_state", _r("decay_confidence").alias("decay_confidence"))


@query("q_decay_v1_hashtags", f"WITH {S.TAGGED}, {S.EVENTS.replace('SELECT event_type AS feature', 'SELECT feature').replace('FROM events', 'FROM tagged')} SELECT feature, trend_state, round(decay_confidence, 6) AS decay_confidence, total_change FROM states")
def q_decay_v1_hashtags(spark, d):
    counts = timeseries.feature_counts(_processed(spark, d), "hashtags", "timestamp", ["1d"]).withColumnRenamed("time_bin", "timestamp")
    return lifecycle.decay_v1(counts).select("feature", "trend_state", _r("decay_confidence").alias("decay_confidence"), "total_change")


@query("q_decay_v3", f"WITH {S.EVENTS} SELECT feature, {S.stamp('b')} AS ts, CASE WHEN g IS NULL OR a IS NULL THEN NULL WHEN g > 0 AND a > 0 THEN 'Growing' WHEN g > 0 THEN 'Peaking' WHEN a < 0 THEN 'Decaying' ELSE 'Stable' END AS state FROM diffs")
def q_decay_v3(spark, d):
    got = timeseries.derivatives(_event_bins(spark, d), ["feature"], "timestamp", "count")
    return got.select("feature", _stamp("timestamp").alias("ts"), lifecycle.decay_v3(F.col("growth"), F.col("acceleration")).alias("state"))


# Terms

def _overall(spark: SparkSession, d: str, n: int) -> DataFrame:
    posts = table(spark, d, "processed_posts").filter("category is not null")
    return tfidf.top_terms(tfidf.term_scores(posts, ["category"], "post_id", "cleaned_text"), ["category"], n)


@query("q_tfidf_overall", "WITH " + S.scores(["category"], "SELECT category, post_id AS doc, cleaned_text AS txt FROM processed_posts WHERE category IS NOT NULL") + " SELECT category, term, round(tfidf_score, 6) AS tfidf_score, rank FROM ranked WHERE rank <= 15")
def q_tfidf_overall(spark, d):
    return _overall(spark, d, 15).select("category", "term", _r("tfidf_score").alias("tfidf_score"), "rank")


def _weekly_posts(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "processed_posts").filter("category is not null and timestamp is not null")
    return posts.withColumn("window_start", F.to_date(timeseries.time_bin(F.col("timestamp"), "1w")))


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    scores = tfidf.term_scores(_weekly_posts(spark, d), ["category", "window_start"], "post_id", "cleaned_text")
    return tfidf.top_terms(scores, ["category", "window_start"], 10)


@query("q_tfidf_weekly", f"WITH {S.WEEKLY} SELECT category, CAST(week AS VARCHAR) AS week, term, round(tfidf_score, 6) AS tfidf_score, rank FROM weekly")
def q_tfidf_weekly(spark, d):
    return _weekly(spark, d).select("category", F.col("window_start").cast("string").alias("week"), "term", _r("tfidf_score").alias("tfidf_score"), "rank")


def _filled(spark: SparkSession, d: str, all_weeks: bool) -> DataFrame:
    weeks = _weekly_posts(spark, d) if all_weeks else None
    # A few rows for each week, read for the times, the terms and the values.
    return timeseries.zero_filled(cut(_weekly(spark, d)), "category", "window_start", "term", "tfidf_score", weeks)


@query("q_zero_fill", f"WITH {S.FILLED} SELECT category, CAST(week AS VARCHAR) AS week, term, round(score, 6) AS tfidf_score FROM filled")
def q_zero_fill(spark, d, all_weeks=False):
    return _filled(spark, d, all_weeks).select("category", F.col("window_start").cast("string").alias("week"), "term", _r("tfidf_score").alias("tfidf_score"))


@query("q_term_stats", f"WITH {S.V2} SELECT category, term, appearances, total_windows, round(max_tfidf, 6) AS max_tfidf, round(min_tfidf, 6) AS min_tfidf, round(latest_tfidf, 6) AS latest_tfidf, round(appearances * CAST(100 AS DOUBLE) / total_windows, 4) AS coverage FROM stats")
def q_term_stats(spark, d, all_weeks=False):
    got = lifecycle.appearances(_filled(spark, d, all_weeks))
    return got.select("category", "term", "appearances", "total_windows", *[_r(c).alias(c) for c in ("max_tfidf", "min_tfidf", "latest_tfidf")], _r(lookup.coverage(F.col("appearances"), F.col("total_windows")), 4).alias("coverage"))


@query("q_decay_v2", f"WITH {S.V2} SELECT category, term, trend_state, round(decay_confidence, 6) AS decay_confidence, round(avg_growth_rate, 6) AS avg_growth_rate FROM v2")
def q_decay_v2(spark, d, all_weeks=False):
    return lifecycle.decay_v2(_filled(spark, d, all_weeks)).select("category", "term", "trend_state", _r("decay_confidence").alias("decay_confidence"), _r("avg_growth_rate").alias("avg_growth_rate"))


@query("q_decay_summary", f"WITH {S.V2} SELECT category, count(*) AS total_terms, " + ", ".join(f"count(*) FILTER (trend_state = '{s}') AS {s.lower()}" for s in lifecycle.STATES) + ", round(count(*) FILTER (trend_state = 'Decaying') * CAST(100 AS DOUBLE) / count(*), 4) AS decay_percentage FROM v2 GROUP BY 1")
def q_decay_summary(spark, d, all_weeks=False):
    got = lifecycle.state_summary(lifecycle.decay_v2(_filled(spark, d, all_weeks)))
    return got.withColumn("decay_percentage", _r("decay_percentage", 4))


@query("q_top_decaying", f"WITH {S.V2} SELECT category, term, round(decay_confidence, 6) AS decay_confidence, round(max_tfidf, 6) AS max_tfidf, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(decay_confidence, 9) DESC, round(max_tfidf, 9) DESC, term) AS rank FROM v2 JOIN stats USING (category, term) WHERE trend_state = 'Decaying') WHERE rank <= 10")
def q_top_decaying(spark, d, all_weeks=False):
    filled = _filled(spark, d, all_weeks)
    both = lifecycle.decay_v2(filled).filter("trend_state = 'Decaying'").join(lifecycle.appearances(filled), ["category", "term"])
    top = lookup.top_k(both, 10, ["category"], [F.desc(_r("decay_confidence", 9)), F.desc(_r("max_tfidf", 9)), F.col("term")])
    return top.select("category", "term", _r("decay_confidence").alias("decay_confidence"), _r("max_tfidf").alias("max_tfidf"), "rank")


@query("q_decaying_terms", f"WITH {S.V2.replace('>= 5)', '>= 2)')} SELECT category, term, round(decay_confidence, 6) AS decay_confidence, appearances FROM v2 JOIN stats USING (category, term) WHERE trend_state = 'Decaying'")
def q_decaying_terms(spark, d):
    """As q_top_decaying, for terms that appear twice at least and without a limit: small tables have such terms."""
    filled = cut(_filled(spark, d, False))
    both = lifecycle.decay_v2(filled).filter("trend_state = 'Decaying'").join(lifecycle.appearances(filled, least=2), ["category", "term"])
    return both.select("category", "term", _r("decay_confidence").alias("decay_confidence"), "appearances")


# The SQL of these has the weeks with a top term; the whole time axis is every week in which the category has a post.
for _name in ("q_zero_fill", "q_term_stats", "q_decay_v2", "q_decay_summary", "q_top_decaying"):
    query(f"{_name}_all_weeks", SQL[_name].replace("SELECT DISTINCT category, week FROM weekly", "SELECT DISTINCT category, week FROM docs"))(partial(QUERIES[_name], all_weeks=True))


# Vocabulary

def _known(spark: SparkSession, d: str, nearest: bool) -> DataFrame | None:
    return vocabulary.known_words(table(spark, d, "term_counts"), "term") if nearest else None


@query("q_spelling", f"SELECT term, coalesce(v, trim(term)) AS corrected, v IS NOT NULL AS was_corrected, count(*) AS records FROM term_counts LEFT JOIN {S.SPELLING} ON lower(trim(term)) = k WHERE term IS NOT NULL GROUP BY 1, 2, 3")
def q_spelling(spark, d, nearest=False):
    terms = table(spark, d, "term_counts").filter("term is not null").select("term")
    return vocabulary.corrected(terms, "term", vocabulary=_known(spark, d, nearest)).groupBy("term", "corrected", "was_corrected").agg(F.count("*").alias("records"))


@query("q_term_pipeline", f"WITH c AS (SELECT DISTINCT term, coalesce(v, trim(term)) AS corrected, v IS NOT NULL AS hit FROM term_counts LEFT JOIN {S.SPELLING} ON lower(trim(term)) = k WHERE term IS NOT NULL), w AS (SELECT *, regexp_split_to_array(lower(trim(corrected)), '\\s+') AS ws FROM c), l AS (SELECT *, {S.LANGUAGE} AS lang FROM w) SELECT term AS original_term, corrected AS processed_term, hit AS spelling_corrected, lang AS source_language, round(CASE WHEN lang = 'unknown' THEN 0 ELSE least(0.9, greatest(0.5, length(trim(corrected)) / CAST(20 AS DOUBLE))) END, 6) AS language_confidence, lang = 'en' AS is_english FROM l")
def q_term_pipeline(spark, d, nearest=False):
    got = vocabulary.processed_terms(table(spark, d, "term_counts"), "term", vocabulary=_known(spark, d, nearest))
    return got.select("original_term", "processed_term", "spelling_corrected", "source_language", _r("language_confidence").alias("language_confidence"), "is_english")


@query("q_vocab_mapping", f"SELECT term_id, term AS term_original, coalesce(v, trim(term)) AS term_processed, v IS NOT NULL AS term_was_corrected FROM term_counts LEFT JOIN {S.SPELLING} ON lower(trim(term)) = k")
def q_vocab_mapping(spark, d, nearest=False):
    terms = table(spark, d, "term_counts").select("term_id", "term")
    got = vocabulary.apply_mapping(terms, "term", vocabulary.processed_terms(terms, "term", vocabulary=_known(spark, d, nearest)))
    return got.select("term_id", "term_original", "term_processed", "term_was_corrected")


@query("q_processing_rates", f"WITH c AS (SELECT DISTINCT term, v IS NOT NULL AS hit FROM term_counts LEFT JOIN {S.SPELLING} ON lower(trim(term)) = k WHERE term IS NOT NULL) SELECT count(*) AS terms, round(count(*) FILTER (hit) * CAST(100 AS DOUBLE) / greatest(count(*), 1), 6) AS spelling_corrected_rate, CAST(0 AS DOUBLE) AS translated_rate FROM c")
def q_processing_rates(spark, d, nearest=False):
    got = vocabulary.processing_rates(vocabulary.processed_terms(table(spark, d, "term_counts"), "term", vocabulary=_known(spark, d, nearest)))
    return got.select("terms", _r("spelling_corrected_rate").alias("spelling_corrected_rate"), "translated_rate")


# The SQL of these has the dictionary alone; these go on to the nearest of the table's own known words.
for _name in ("q_spelling", "q_term_pipeline", "q_vocab_mapping", "q_processing_rates"):
    query(f"{_name}_nearest", S.with_nearest(SQL[_name]))(partial(QUERIES[_name], nearest=True))


@query("q_translated_terms", f"WITH c AS (SELECT DISTINCT term, coalesce(v, trim(term)) AS corrected FROM term_counts LEFT JOIN {S.SPELLING} ON lower(trim(term)) = k WHERE term IS NOT NULL), w AS (SELECT *, regexp_split_to_array(lower(trim(corrected)), '\\s+') AS ws FROM c), l AS (SELECT *, {S.LANGUAGE} AS lang FROM w), t AS (SELECT *, lang NOT IN ('en', 'unknown') AND least(0.9, greatest(0.5, length(trim(corrected)) / CAST(20 AS DOUBLE))) >= 0.7 AND lower(corrected) IN (SELECT lower(trim(term)) FROM term_counts WHERE feature_type = 'phrase') AS hit FROM l) SELECT term AS original_term, CASE WHEN hit THEN '[' || lower(corrected) || ']' ELSE corrected END AS processed_term, hit AS translated, lang AS source_language FROM t")
def q_translated_terms(spark, d):
    """The look-up in a table of translations, here one that puts each phrase in brackets."""
    terms = table(spark, d, "term_counts")
    phrases = terms.filter("feature_type = 'phrase'").select(F.lower(F.trim("term")).alias("term")).filter("term is not null").distinct()
    got = vocabulary.processed_terms(terms, "term", translations=phrases.withColumn("translation", F.concat(F.lit("["), "term", F.lit("]"))))
    return got.select("original_term", "processed_term", "translated", "source_language")


@query("q_language_distribution", "SELECT source_language, count(*) AS records FROM term_counts WHERE source_language IS NOT NULL GROUP BY 1")
def q_language_distribution(spark, d):
    return vocabulary.value_counts(table(spark, d, "term_counts"), "source_language").withColumnRenamed("count", "records")


# Vectors

@query("q_cosine", "WITH c AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1), f AS (SELECT e.label, e.embedding FROM embeddings e JOIN c ON e.vec_id = c.ids[1]) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings e JOIN f USING (label)")
def q_cosine(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", _r(semantic.cosine(F.col("embedding"), F.col("first")), 5).alias("cosine"))


_COHERENCE = "WITH p AS (SELECT a.label AS cluster_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), m AS (SELECT cluster_id, avg(c) AS coherence FROM p GROUP BY 1), n AS (SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1), o AS (SELECT cluster_id, size, coalesce(coherence, 1) AS coherence FROM n LEFT JOIN m USING (cluster_id))"


@query("q_coherence", f"{_COHERENCE} SELECT cluster_id, size, round(coherence, 5) AS coherence FROM o")
def q_coherence(spark, d):
    return semantic.coherence(table(spark, d, "embeddings"), "label", "embedding").select("cluster_id", "size", _r("coherence", 5).alias("coherence"))


@query("q_average_coherence", f"{_COHERENCE} SELECT round(avg(coherence), 5) AS average_coherence FROM o")
def q_average_coherence(spark, d):
    return semantic.coherence(table(spark, d, "embeddings"), "label", "embedding").agg(_r(F.avg("coherence"), 5).alias("average_coherence"))


@query("q_cluster_stats", f"WITH {S.series('1d')}, c AS (SELECT CAST(length(feature) AS INTEGER) AS cluster_id, * FROM trend) SELECT cluster_id, round(avg(rate), 3) AS mean_rate, count(rate) AS features, CAST(sum(n) AS BIGINT) AS total_count FROM c GROUP BY 1")
def q_cluster_stats(spark, d):
    return semantic.cluster_stats(_series(spark, d, "1d").withColumn("cluster_id", F.length("feature")))


@query("q_cluster_lookup", f"WITH {S.series('1w')}, r AS (SELECT feature FROM trend WHERE rate > 0 GROUP BY 1) SELECT {S.stamp('b')} AS time_bin, feature, n AS count, CASE WHEN r.feature IS NULL THEN -1 ELSE length(feature) END AS cluster_id, CASE WHEN r.feature IS NULL THEN 0.0 ELSE 0.5 END AS coherence_score, CASE WHEN r.feature IS NULL THEN 1 ELSE 7 END AS cluster_size FROM trend LEFT JOIN r USING (feature)")
def q_cluster_lookup(spark, d):
    """The look-up of clusters by feature, with its defaults; here a cluster for each length of a feature."""
    series = _series(spark, d, "1w")
    of = series.select("feature").distinct().select("feature", F.length("feature").alias("cluster_id"), F.lit(0.5).alias("coherence_score"), F.lit(7).alias("cluster_size"))
    return semantic.semantic_trends(series, of).select(_stamp("time_bin").alias("time_bin"), "feature", "count", "cluster_id", "coherence_score", "cluster_size")


@query("q_kmeans_check", "SELECT (SELECT count(*) FROM embeddings) AS vectors, true AS few_clusters, true AS every_vector_once, true AS closer_than_all")
def q_kmeans_check(spark, d):
    """What must hold of any clustering: all vectors once, no more clusters than asked for, and vectors closer to the
    mean of their cluster than to the mean of all."""
    got = semantic.clusters(table(spark, d, "embeddings"), "embedding", 10).select("vec_id", "cluster_id", "embedding")
    parts = got.select("vec_id", "cluster_id", F.posexplode("embedding").alias("i", "x"))
    spread = lambda by: parts.join(parts.groupBy(*by).agg(F.avg("x").alias("m")), by).agg(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("s"))
    own, all_ = spread(["cluster_id", "i"]).withColumnRenamed("s", "own"), spread(["i"]).withColumnRenamed("s", "every")
    counts = got.agg(F.count("*").alias("vectors"), (F.count_distinct("cluster_id") <= 10).alias("few_clusters"), (F.count_distinct("vec_id") == F.count("*")).alias("every_vector_once"))
    one = _side_by_side(counts, own, all_)
    return one.select("vectors", "few_clusters", "every_vector_once", (F.col("own") < F.col("every")).alias("closer_than_all"))


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


@query("q_kmeans")
def q_kmeans(spark, d):
    return semantic.clusters(table(spark, d, "embeddings"), "embedding", 10).select("vec_id", "cluster_id")


@query("q_semantic_trends_check", f"WITH {S.series('1w')}, r AS (SELECT feature FROM trend WHERE rate > 0 GROUP BY 1) SELECT (SELECT count(*) FROM trend) AS rows, (SELECT count(*) FROM trend WHERE feature NOT IN (SELECT feature FROM r)) AS unclustered, (SELECT count(*) FROM r) AS features, true AS in_bounds")
def q_semantic_trends_check(spark, d):
    """What must hold of any clusters: every row once, falling features in none, sizes that sum to the rising features."""
    got = q_semantic_trends(spark, d)
    clusters = got.filter("cluster_id >= 0").select("cluster_id", "cluster_size", "coherence_score").distinct()
    counts = got.agg(F.count("*").alias("rows"), F.count_if(F.col("cluster_id") == -1).alias("unclustered"))
    sizes = clusters.agg(F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("features"), F.coalesce(F.bool_and(F.abs("coherence_score") <= 1.000001), F.lit(True)).alias("in_bounds"))
    return _side_by_side(counts, sizes)


@query("q_semantic_trends")
def q_semantic_trends(spark, d):
    series = _series(spark, d, "1w")
    vectors = semantic.hashed_embeddings(series.filter("rate_of_change > 0").select("feature").distinct().withColumn("grams", F.split("feature", "")), "grams", 64)
    from pyspark.ml.functions import vector_to_array

    grouped = semantic.clusters(vectors.withColumn("embedding", vector_to_array("embedding")), "embedding", 8)
    c = semantic.coherence(grouped, "cluster_id", "embedding").select("cluster_id", F.col("coherence").alias("coherence_score"), F.col("size").alias("cluster_size"))
    return semantic.semantic_trends(series, grouped.join(c, "cluster_id")).select("time_bin", "feature", "count", "cluster_id", "coherence_score", "cluster_size")


# Look-up

@query("q_leaderboard", "WITH " + S.scores(["category"], "SELECT category, post_id AS doc, cleaned_text AS txt FROM processed_posts WHERE category IS NOT NULL") + " SELECT CAST(rank AS INTEGER) AS trend_id, upper(category[1]) || category[2:] AS category, term, CAST(floor(tfidf_score * 1000) AS INTEGER) AS trend_score, round(least(0.95, 0.5 + tfidf_score), 6) AS sentiment_score FROM ranked WHERE rank <= 25")
def q_leaderboard(spark, d):
    return lookup.trend_rows(_overall(spark, d, 25)).withColumn("sentiment_score", _r("sentiment_score"))


@query("q_facets", "SELECT post_id, category, dataset_type FROM processed_posts WHERE category IN ('makeup', 'hair') AND dataset_type IN ('videos')")
def q_facets(spark, d):
    return lookup.facets(table(spark, d, "processed_posts"), {"category": ["makeup", "hair"], "dataset_type": ["videos"], "declared_lang": []}).select("post_id", "category", "dataset_type")


@query("q_all_terms", f"SELECT DISTINCT term FROM (SELECT term FROM term_counts UNION ALL SELECT lower(unnest(regexp_extract_all(textOriginal, {S.text(L.HASHTAG)}, 1))) FROM comments) WHERE regexp_matches(translate(regexp_replace(term, '^#+', ''), '_', ' '), {S.text(rf'^[{L.SPACE}]*\p{{L}}+([{L.SPACE}]+\p{{L}}+)*[{L.SPACE}]*$')})")
def q_all_terms(spark, d):
    return lookup.all_terms(table(spark, d, "term_counts").select("term"), q_hashtags(spark, d).select("tag"))


@query("q_fuzzy_lookup", f"WITH {S.WEEKLY}, h AS (SELECT DISTINCT category, term, {S.NAME} AS own FROM weekly), m AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY own = 'mascara' DESC, term) AS r FROM h WHERE own <> '' AND (contains(own, 'mascara') OR contains('mascara', own))) SELECT category, term, own = 'mascara' AS exact FROM m WHERE r = 1")
def q_fuzzy_lookup(spark, d):
    return lookup.fuzzy_lookup(_weekly(spark, d).select("category", "term").distinct(), "#Mascara").select("category", "term", "exact")


@query("q_best_temporal_match", f"WITH {S.WEEKLY}, h AS (SELECT *, {S.NAME} AS own FROM weekly), m AS (SELECT *, contains(own, 'cream blush') OR contains('cream blush', own) AS part, list_has_any(list_filter(string_split(own, ' '), lambda w: length(w) > 2), ['cream', 'blush']) AS shared FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY category, week ORDER BY part DESC, rank, term) AS r FROM m WHERE own <> '' AND (part OR shared)), t AS (SELECT category, count(*) AS windows, sum(CASE WHEN part THEN tfidf_score ELSE tfidf_score / 2 END * 1000) AS match_score FROM f WHERE r = 1 GROUP BY 1) SELECT category, windows, round(match_score, 4) AS match_score FROM t ORDER BY round(t.match_score, 9) DESC, category LIMIT 1")
def q_best_temporal_match(spark, d):
    return lookup.best_temporal_match(_weekly(spark, d), "Cream_Blush").withColumn("match_score", _r("match_score", 4))


_LAST = f"WITH {S.EVENTS}, e AS (SELECT feature, arg_max(n, b) AS last_n, arg_min(n, b) AS first_n, max(b) AS last_b FROM binned GROUP BY 1)"


@query("q_forecast_rates", f"{_LAST}, s AS (SELECT unnest(range(1, 13)) AS step) SELECT feature, CAST(step AS INTEGER) AS step, round(greatest(last_n * pow(1 + (last_n - first_n) / CAST(1000 AS DOUBLE), step), 0), 4) AS value FROM e, s")
def q_forecast_rates(spark, d):
    """The forecast with a rate for each feature."""
    bins_ = _event_bins(spark, d)
    last = bins_.groupBy("feature").agg(F.max_by("count", "timestamp").alias("start"), F.max("timestamp").alias("at"), ((F.max_by("count", "timestamp") - F.min_by("count", "timestamp")) / 1000.0).alias("rate"))
    return timeseries.forecast(last, "start", "rate", "at").select("feature", "step", _r("value", 4).alias("value"))


@query("q_dashboard", "WITH " + S.scores(["category"], "SELECT category, post_id AS doc, cleaned_text AS txt FROM processed_posts WHERE category IS NOT NULL") + " SELECT term AS \"Trend\", upper(category[1]) || category[2:] AS \"Category\", CAST(floor(tfidf_score * 1000) AS INTEGER) AS \"Score\", round(least(0.95, 0.5 + tfidf_score), 6) AS \"Sentiment\" FROM ranked WHERE rank <= 10")
def q_dashboard(spark, d):
    """The columns that a dashboard shows, for the first ten terms of each category."""
    return lookup.dashboard(lookup.trend_rows(_overall(spark, d, 10))).withColumn("Sentiment", _r("Sentiment"))


@query("q_row_counts", "SELECT 'comments' AS name, count(*) AS rows FROM comments UNION ALL SELECT 'videos', count(*) FROM videos")
def q_row_counts(spark, d):
    """Counts without columns, which the files' footers answer."""
    one, other = (table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in ("comments", "videos"))
    return one.unionByName(other)


@query("q_table_profile", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', (SELECT count(*) FROM videos), (SELECT count(*) FROM videos WHERE \"{c}\" IS NULL), (SELECT count(DISTINCT \"{c}\") FROM videos))" for c in ("channelId", "videoId", "title", "tags", "viewCount", "publishedAt")) + ") AS t(\"column\", rows, nulls, distinct_values)")
def q_table_profile(spark, d):
    videos = table(spark, d, "videos").select("channelId", "videoId", "title", "tags", "viewCount", "publishedAt")
    return files.table_profile(videos).drop("type")


@query("q_forecast", f"{_LAST}, s AS (SELECT unnest(range(1, 13)) AS step) SELECT feature, CAST(step AS INTEGER) AS step, CAST(CAST(last_b AS DATE) + CAST((7 - (isodow(last_b + INTERVAL 6 DAY) % 7)) + 6 + (step - 1) * 7 AS INTEGER) AS VARCHAR) AS week, round(last_n * pow(CAST(1.02 AS DOUBLE), step), 4) AS value FROM e, s")
def q_forecast(spark, d):
    bins_ = _event_bins(spark, d)
    last = bins_.groupBy("feature").agg(F.max_by("count", "timestamp").alias("start"), F.max("timestamp").alias("at")).withColumn("rate", F.lit(None).cast("double"))
    return timeseries.forecast(last, "start", "rate", "at").select("feature", "step", F.col("week").cast("string").alias("week"), _r("value", 4).alias("value"))


@query("q_direction", f"{_LAST} SELECT feature, CAST(last_n - first_n AS BIGINT) AS change, CASE WHEN last_n > first_n THEN 'Growth' WHEN last_n < first_n THEN 'Decline' ELSE 'Stable' END AS direction FROM e")
def q_direction(spark, d):
    ends = _event_bins(spark, d).groupBy("feature").agg(F.min_by("count", "timestamp").alias("a"), F.max_by("count", "timestamp").alias("b"))
    return ends.select("feature", (F.col("b") - F.col("a")).alias("change"), lookup.direction(F.col("a"), F.col("b")).alias("direction"))


# Whole tables, files, streams

@query("q_dataset_stats", f"WITH {S.POSTS} SELECT dataset_type, count(*) AS posts, count(DISTINCT video_id) AS videos, round(avg(engagement), 4) AS mean_engagement, round(max(engagement), 4) AS max_engagement, {S.stamp('min(ts)')} AS first_ts, {S.stamp('max(ts)')} AS last_ts FROM posts GROUP BY 1")
def q_dataset_stats(spark, d):
    posts = standardise.posts(table(spark, d, "comments"), table(spark, d, "videos"))
    return posts.groupBy("dataset_type").agg(
        F.count("*").alias("posts"), F.count_distinct("video_id").alias("videos"), _r(F.avg("engagement_score"), 4).alias("mean_engagement"),
        _r(F.max("engagement_score"), 4).alias("max_engagement"), _stamp(F.min("timestamp")).alias("first_ts"), _stamp(F.max("timestamp")).alias("last_ts"),
    )


@query("q_reply_counts", f"WITH {S.COMMENTS} SELECT videoId AS video_id, count(*) AS comments, count(*) FILTER (reply) AS replies FROM comments_std GROUP BY 1")
def q_reply_counts(spark, d):
    return _comments(spark, d).groupBy("video_id").agg(F.count("*").alias("comments"), F.count_if("is_reply").alias("replies"))


@query("q_top_posts", f"WITH {S.VIDEOS} SELECT videoId AS video_id, round(engagement, 4) AS engagement_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY channelId ORDER BY engagement DESC, videoId) AS rank FROM videos_std) WHERE rank <= 5")
def q_top_posts(spark, d):
    top = lookup.top_k(_videos(spark, d), 5, ["channel_id"], [F.desc("engagement_score"), F.col("video_id")])
    return top.select("video_id", _r("engagement_score", 4).alias("engagement_score"), "rank")


@query("q_sample", "SELECT commentId, textOriginal FROM comments ORDER BY md5(commentId) NULLS FIRST, updatedAt NULLS FIRST, textOriginal NULLS FIRST LIMIT 1000")
def q_sample(spark, d):
    """A sampling operator: a thousand comments by a hash of their id."""
    return table(spark, d, "comments").orderBy(F.md5("commentId"), "updatedAt", "textOriginal").limit(1000).select("commentId", "textOriginal")


_PROFILE = {
    "channelId": "string", "videoId": "string", "title": "string", "description": "string", "tags": "string", "defaultLanguage": "string", "defaultAudioLanguage": "string",
    "contentDuration": "string", "topicCategories": "string", "viewCount": "int", "likeCount": "int", "favouriteCount": "int", "commentCount": "int", "publishedAt": "timestamp",
}


@query("q_csv_profile", f"WITH p AS (SELECT unnest([{S.in_list(_PROFILE)}]) AS \"column\", unnest([{S.in_list(_PROFILE.values())}]) AS type) SELECT \"column\", type, (SELECT CAST(count(*) AS BIGINT) FROM videos) AS lines FROM p")
def q_csv_profile(spark, d):
    from tidemark.session import shared_folder

    path = shared_folder(spark, "videos_csv")
    table(spark, d, "videos").write.mode("overwrite").csv(path, header=True)
    return files.csv_profile(spark, path)


@query("q_json_flatten", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS \"props.k\" FROM events")
def q_json_flatten(spark, d):
    events = table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:long>").alias("props"))
    return files.flattened(events)


@query("q_stream_timebin", f"SELECT {S.stamp(S.time_bin('6h', 'ts'))} AS time_bin, event_type AS feature, count(*) AS count FROM events WHERE {S.time_bin('6h', 'ts')} + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def q_stream_timebin(spark, d):
    from tidemark.session import shared_folder

    static = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parquet*")
    got = bins.drain(bins.windowed_counts(stream, "ts", "event_type"), "bins", shared_folder(spark, "stream", fresh=True))
    return got.select(_stamp("time_bin").alias("time_bin"), "feature", "count")


# Further bins, shapes and stages

for _w, _seconds in (("3h", 10800), ("3d", 259200), ("7d", 604800), ("14d", 1209600)):
    @query(f"q_timebin_{_w}", f"SELECT {S.stamp(f'make_timestamp(CAST(floor(epoch(ts) / {_seconds}) AS BIGINT) * {_seconds} * 1000000)')} AS time_bin, event_type AS feature, count(*) AS count, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
    def _event_timebin(spark, d, i=_w):
        events = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("string"))
        got = timeseries.feature_counts(events, "event_type", "ts", [i], audio="user_id")
        return got.select(_stamp("time_bin").alias("time_bin"), "feature", "count", F.col("unique_audio_ids").alias("users"))


@query("q_hashtag_characters", f"WITH {S.TAGGED} SELECT {S.stamp(S.time_bin('1d'))} AS time_bin, feature, len(list_distinct(string_split(feature, ''))) AS unique_hashtags FROM tagged GROUP BY 1, 2")
def q_hashtag_characters(spark, d):
    got = timeseries.feature_counts(_processed(spark, d), "hashtags", "timestamp", ["1d"], strict_compat=True)
    return got.select(_stamp("time_bin").alias("time_bin"), "feature", "unique_hashtags")


@query("q_densified", f"WITH {S.EVENTS.split('grown AS')[0].rstrip().rstrip(',')}, e AS (SELECT feature, min(b) AS a, max(b) AS z FROM binned GROUP BY 1), g AS (SELECT feature, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS b FROM e) SELECT feature, {S.stamp('b')} AS ts, coalesce(n, 0) AS count FROM g LEFT JOIN binned USING (feature, b)")
def q_densified(spark, d):
    got = timeseries.densified(_event_bins(spark, d), ["feature"], "timestamp", "count", "1d")
    return got.select("feature", _stamp("timestamp").alias("ts"), "count")


@query("q_first_occurrences", "SELECT cleaned_text, min(post_id) AS post_id FROM processed_posts GROUP BY 1")
def q_first_occurrences(spark, d):
    return semantic.first_occurrences(table(spark, d, "processed_posts"), "cleaned_text", "post_id")


@query("q_vector_columns", "SELECT vec_id, embedding[1] AS v_0, embedding[2] AS v_1, embedding[3] AS v_2 FROM embeddings")
def q_vector_columns(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *hooks.vector_columns("embedding", 3, "v"))


@query("q_vector_columns_all", f"SELECT vec_id, {', '.join(f'embedding[{k + 1}] AS v_{k}' for k in range(VECTOR))} FROM embeddings")
def q_vector_columns_all(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *hooks.vector_columns("embedding", VECTOR, "v"))


@query("q_union_columns", "SELECT videoId, textOriginal, NULL AS title, likeCount FROM comments UNION ALL SELECT videoId, NULL, title, likeCount FROM videos")
def q_union_columns(spark, d):
    comments = table(spark, d, "comments").select("videoId", "textOriginal", "likeCount")
    return comments.unionByName(table(spark, d, "videos").select("videoId", "title", "likeCount"), allowMissingColumns=True)


@query("q_rising", f"WITH {S.series('1w')} SELECT {S.stamp('b')} AS time_bin, feature, n AS count, round(rate, 6) AS rate_of_change FROM trend WHERE rate > 0")
def q_rising(spark, d):
    got = _series(spark, d, "1w").filter("rate_of_change > 0")
    return got.select(_stamp("time_bin").alias("time_bin"), "feature", "count", _r("rate_of_change").alias("rate_of_change"))


@query("q_token_series", f"WITH {S.POSTS}, w AS (SELECT k, ts, unnest(string_split(cleaned, ' ')) AS feature FROM numbered) SELECT {S.stamp(S.time_bin('1d'))} AS time_bin, feature, count(*) AS count FROM w WHERE length(feature) > 2 AND feature NOT IN ({S.in_list(L.STOP_WORDS)}) GROUP BY 1, 2")
def q_token_series(spark, d):
    got = pipeline.feature_series(_processed(spark, d), {"series": {"intervals": ["1d"], "features": ["tokens"]}})
    return got.select(_stamp("time_bin").alias("time_bin"), "feature", "count")


@query("q_text_columns", "SELECT post_id, CASE WHEN hashtags IS NULL THEN NULL ELSE '[' || array_to_string(list_transform(hashtags, lambda x: '\"' || x || '\"'), ',') || ']' END AS hashtags FROM processed_posts")
def q_text_columns(spark, d):
    return files.as_text_columns(table(spark, d, "processed_posts").select("post_id", "hashtags"))


@query("q_model_labels", "SELECT post_id, CASE WHEN coalesce(cleaned_text, '') NOT SIMILAR TO '(.|\\n)*[^\\s\\p{Z}](.|\\n)*' THEN 'none' WHEN length(cleaned_text) > 80 THEN 'long' ELSE 'short' END AS label, CASE WHEN coalesce(cleaned_text, '') NOT SIMILAR TO '(.|\\n)*[^\\s\\p{Z}](.|\\n)*' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM processed_posts")
def q_model_labels(spark, d):
    """The hook for models, with a model that reads the length."""
    model = lambda texts: [("long" if len(t) > 80 else "short", 1.0) for t in texts]
    got = table(spark, d, "processed_posts").select("post_id", hooks.labelled_by(model, F.col("cleaned_text"), ("none", 0.0)).alias("x"))
    return got.select("post_id", "x.*")


def _picked(words, salt: str) -> str:
    return f"([{S.in_list(words)}])[CAST({S.drawn('i', salt)} % {len(words)} + 1 AS BIGINT)]"


@query("q_synthetic_posts", f"SELECT 'c' || i AS commentId, CAST(NULL AS VARCHAR) AS parentCommentId, 'v' || (i % 97) AS videoId, 'u' || (i % 1009) AS authorId, CASE WHEN i % 10 = 0 THEN {_picked(synthetic.OTHER, 'o')} ELSE {_picked(synthetic.OPENINGS, 'a')} || ' ' || {_picked(synthetic.THINGS, 'b')} END AS textOriginal, CAST({S.drawn('i', 'l')} % 500 AS BIGINT) AS likeCount, {S.stamp(f"make_timestamp((1704067200 + {S.drawn('i', 't')} % 2592000) * 1000000)")} AS publishedAt FROM range(10000) r(i)")
def q_synthetic_posts(spark, d):
    return synthetic.synthetic_posts(spark, 10_000).withColumn("publishedAt", _stamp("publishedAt"))


@query("q_seeded_history", f"SELECT CAST(DATE '2024-01-01' + CAST(i * 7 AS INTEGER) AS VARCHAR) AS window_start, 'lip tint' AS term, 20 + {S.drawn('i', 'lip tint')} % 60 + i * 2.0::DOUBLE AS value FROM range(12) r(i)")
def q_seeded_history(spark, d):
    return synthetic.seeded_history(spark, "lip tint").withColumn("window_start", F.col("window_start").cast("string"))


_PIPELINE = (
    S.POSTS.replace("numbered AS (", "numbered AS MATERIALIZED (") + ", " + S.scores(["category", "week"], "SELECT category, CAST(date_trunc('week', ts) AS DATE) AS week, k AS doc, txt FROM numbered WHERE category IN (SELECT category FROM numbered GROUP BY 1 HAVING count(*) >= 50)")
    + ", weekly AS (SELECT * FROM ranked WHERE rank <= 10)"
)


@query("q_stage_weekly_terms", f"WITH {_PIPELINE} SELECT category, CAST(week AS VARCHAR) AS week, term, round(tfidf_score, 6) AS tfidf_score, rank FROM weekly")
def q_stage_weekly_terms(spark, d):
    got = pipeline.run(table(spark, d, "comments"), table(spark, d, "videos"), wanted=["weekly_terms"])["weekly_terms"]
    return got.select("category", F.col("window_start").cast("string").alias("week"), "term", _r("tfidf_score").alias("tfidf_score"), "rank")


_STAGED = f"{S.POSTS}, f AS (SELECT 'hashtags' AS feature_type, ts, lower(unnest(regexp_extract_all(txt, {S.text(L.HASHTAG)}, 1))) AS feature FROM processed UNION ALL SELECT 'tokens', ts, feature FROM (SELECT ts, unnest(string_split(cleaned, ' ')) AS feature FROM processed) WHERE length(feature) > 2 AND feature NOT IN ({S.in_list(L.STOP_WORDS)}))"
_STAGED += "".join(f", n_{i} AS (SELECT '{i}' AS interval, feature_type, {S.time_bin(i)} AS b, feature, count(*) AS n FROM f GROUP BY 2, 3, 4)" for i in ("1h", "6h")) + ", n AS (FROM n_1h UNION ALL FROM n_6h)"


@query("q_stage_candidates", f"WITH {_STAGED} SELECT interval, feature_type, {S.stamp('b')} AS time_bin, feature, n AS count, round(avg(n) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_mean, round(coalesce(CAST(n - lag(n) OVER w AS DOUBLE) / lag(n) OVER w, 0), 6) AS rate_of_change FROM n WINDOW w AS (PARTITION BY interval, feature_type, feature ORDER BY b)")
def q_stage_candidates(spark, d):
    got = pipeline.run(table(spark, d, "comments"), table(spark, d, "videos"), wanted=["candidates"])["candidates"]
    return got.select("interval", "feature_type", _stamp("time_bin").alias("time_bin"), "feature", "count", _r("rolling_mean").alias("rolling_mean"), _r("rate_of_change").alias("rate_of_change"))


@query("q_pipeline_lifecycle", f"WITH {_PIPELINE}" + S.V2.removeprefix(S.WEEKLY).replace("SELECT DISTINCT category, week FROM weekly", "SELECT DISTINCT category, week FROM docs").replace(">= 5)", ">= 2)") + " SELECT category, term, trend_state, round(decay_confidence, 6) AS decay_confidence, round(avg_growth_rate, 6) AS avg_growth_rate, appearances, total_windows, round(max_tfidf, 6) AS max_tfidf, round(min_tfidf, 6) AS min_tfidf, round(latest_tfidf, 6) AS latest_tfidf FROM v2 JOIN stats USING (category, term)")
def q_pipeline_lifecycle(spark, d):
    """All stages in one plan over the raw tables."""
    got = pipeline.run(table(spark, d, "comments"), table(spark, d, "videos"), config={"lifecycle": {"least_appearances": 2}}, wanted=["lifecycle"])["lifecycle"]
    return got.select("category", "term", "trend_state", *[_r(c).alias(c) for c in ("decay_confidence", "avg_growth_rate")], "appearances", "total_windows", *[_r(c).alias(c) for c in ("max_tfidf", "min_tfidf", "latest_tfidf")])


# Stages with the default settings; the smallest tables are too small for a lifecycle with these.
for _stage in ("posts", "series"):
    @query(f"q_stage_{_stage}")
    def _pipeline_stage(spark, d, stage=_stage):
        return pipeline.run(table(spark, d, "comments"), table(spark, d, "videos"), wanted=[stage])[stage]

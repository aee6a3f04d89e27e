"""Raw comment and video tables to one schema of posts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify, text

ENGAGEMENT = (("viewCount", 0.1), ("likeCount", 2.0), ("commentCount", 1.5), ("favouriteCount", 3.0))


def detect_dataset_type(columns: Iterable[str]) -> str | None:
    """'comments', 'videos' or None, by the columns alone."""
    have = set(columns)
    if have >= {"textOriginal", "commentId", "parentCommentId"}:
        return "comments"
    if have >= {"title", "description", "videoId"}:
        return "videos"
    return "comments" if "textOriginal" in have else "videos" if "title" in have else None


def _col(df: DataFrame, name: str, kind: str, default: object = None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(_col(df, name, "double").try_cast("double"), F.lit(0.0))


def _time(df: DataFrame) -> Column:
    return F.col("publishedAt").try_cast("timestamp")


def standardise_comments(df: DataFrame) -> DataFrame:
    """All columns of the input and timestamp, text, engagement_score, is_reply, video_id, author_id, dataset_type.

    Rows with a null or unreadable time or a null or empty text are dropped; counts that are no numbers are 0."""
    out = df.withColumns({
        "timestamp": _time(df), "text": F.col("textOriginal"), "engagement_score": _number(df, "likeCount"),
        "is_reply": _col(df, "parentCommentId", "string").isNotNull(), "video_id": _col(df, "videoId", "string"),
        "author_id": _col(df, "authorId", "string"), "dataset_type": F.lit("comments"),
    })
    return out.filter(F.col("timestamp").isNotNull() & (F.length("text") > 0))


def engagement(df: DataFrame) -> Column:
    out = F.lit(0.0)
    for name, weight in ENGAGEMENT:
        if name in df.columns:
            out = out + _number(df, name) * weight
    return out


def standardise_videos(df: DataFrame) -> DataFrame:
    """As for comments; the text is title, description and tags with a blank between, a null part being ''."""
    parts = [F.coalesce(_col(df, c, "string"), F.lit("")) for c in ("title", "description", "tags")]
    out = df.withColumns({
        "timestamp": _time(df), "text": F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]),
        "engagement_score": engagement(df), "video_id": _col(df, "videoId", "string"), "channel_id": _col(df, "channelId", "string"),
        "content_duration": _col(df, "contentDuration", "string"), "topic_categories": _col(df, "topicCategories", "string"),
        "dataset_type": F.lit("videos"),
    })
    return out.filter(F.col("timestamp").isNotNull() & (F.length("text") > 0))


def standardise(df: DataFrame) -> DataFrame | None:
    kind = detect_dataset_type(df.columns)
    return {"comments": standardise_comments, "videos": standardise_videos}[kind](df) if kind else None


POST = ["dataset_type", "video_id", "timestamp", "text", "engagement_score"]


def posts(*frames: DataFrame) -> DataFrame:
    """The standard columns of comment and video tables, one under another."""
    known = [s.select(*POST, *[c for c in ("author_id", "channel_id", "is_reply", "content_duration", "topic_categories") if c in s.columns]) for s in map(standardise, frames) if s is not None]
    out = known[0]
    for other in known[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def processed(standard: DataFrame) -> DataFrame:
    """Relevant posts with cleaned_text, hashtags, tokens and category; posts without a category are dropped.

    The relevance test reads the raw text, the category the cleaned one, so a word in an address alone passes the
    first and not the second."""
    kept = standard.filter(text.relevant(F.col("text")))
    out = _once(_once(kept, "cleaned_text", text.clean(F.col("text"))), "category", classify.category(F.col("cleaned_text")))
    out = out.filter("category is not null")
    return out.withColumns({"hashtags": text.hashtags(F.col("text")), "tokens": text.tokens(F.col("cleaned_text"))})


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row: filters on it and columns made of it aren't merged with it, as
    they would be with a plain projection."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))

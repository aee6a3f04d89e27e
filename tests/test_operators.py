"""Operators on small tables worked out by hand, and their behaviour on odd ones."""

import datetime as dt
import json
import random
import zipfile
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import classify, text
from tidemark.functions import lexicon as L
from tidemark.operators import lifecycle, lookup, semantic, standardise, tfidf, timeseries, vocabulary
from tidemark.plans import pipeline
from tidemark.sources import files, synthetic
from tidemark.streaming import bins

TEXTS = [
    ("Love this #skincare routine! #glowup #beauty", True, "love this #skincare routine #glowup #beauty", "skincare", ["skincare", "glowup", "beauty"]),
    ("This #niacinamide serum is amazing! #skincare", True, "this #niacinamide serum is amazing #skincare", "skincare", ["niacinamide", "skincare"]),
    ("Politics and news today", False, "politics and news today", None, []),
    ("#OOTD looking fresh! #fashion #style", True, "#ootd looking fresh #fashion #style", "fashion", ["ootd", "fashion", "style"]),
    ("see https://x.co/skincare", True, "see", None, []),
    ("@hairfan hello", True, "hello", None, []),
    ("sitting on a chair", True, "sitting on a chair", "hair", []),
    ("美容 glow ✨", True, "glow", "beauty", []),
    ("Café #Été_1 #été_1 x#frag glow", True, "café #été_1 #été_1 x#frag glow", "beauty", ["été_1", "été_1", "frag"]),
    ("", False, "", None, []),
    (None, False, "", None, []),
]


def test_text(spark):
    df = spark.createDataFrame([(k, t[0]) for k, t in enumerate(TEXTS)], "k int, t string")
    c = text.clean(F.col("t"))
    rows = df.select("k", text.relevant(F.col("t")).alias("r"), c.alias("c"), classify.category(c).alias("g"), text.hashtags(F.col("t")).alias("h")).orderBy("k").collect()
    assert [(r.r, r.c, r.g, r.h) for r in rows] == [t[1:] for t in TEXTS]


SERIES = {
    "short": ([1, 2, 3], None, 0, "Insufficient_Data", 0), "four": ([1, 10, 15, 17], "Growing", 0, "Decaying", 1.0),
    "decay": ([1, 20, 35, 45, 50], "Decaying", 0.4667, "Decaying", 1.0), "fast": ([1, 2, 4, 8, 16], "Accelerating", 0, "Accelerating", 0),
    "grow": ([2, 4, 6, 8, 10], "Growing", 0, "Growing", 0), "fall": ([10, 8, 6, 4, 2], "Declining", 0, "Declining", 0),
    "flat": ([5] * 5, "Stable", 0, "Stable", 0), "saw": ([1, 9, 2, 9, 3], "Stable", 0, "Declining", 0),
}


def test_lifecycles(spark):
    rows = [(n, dt.datetime(2024, 1, 1 + k), v) for n, (vs, *_) in SERIES.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "feature string, timestamp timestamp, count long")
    v1 = {r.feature: (r.trend_state, round(r.decay_confidence, 4)) for r in lifecycle.decay_v1(df).collect()}
    v2 = {r.feature: (r.trend_state, round(r.decay_confidence, 4)) for r in lifecycle.decay_v2(df.withColumn("count", F.col("count").cast("double")), ["feature"], "timestamp", "count").collect()}
    for name, (_, s1, c1, s2, c2) in SERIES.items():
        assert v1.get(name) == ((s1, c1) if s1 else None)
        assert v2[name] == (s2, c2)
    whole = lifecycle.decay_v1_enriched(df, lifecycle.decay_v1(df))
    assert whole.count() == len(rows) and whole.filter("feature = 'short'").first().trend_state == "Unknown"


def test_bins_by_hand(spark):
    rows = [(dt.datetime(2024, 1, 1, 13), ["glow", "ootd"]), (dt.datetime(2024, 1, 1, 14), ["glow"]), (dt.datetime(2024, 1, 2, 13), ["glow"]), (None, ["glow"]), (dt.datetime(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "t timestamp, tags array<string>")
    got = timeseries.with_trend(timeseries.feature_counts(df, "tags", "t", ["6h"], hashtags="tags")).orderBy("feature", "time_bin").collect()
    assert [(r.feature, r["count"], r.unique_hashtags, r.rate_of_change, r.rolling_mean) for r in got] == [("glow", 2, 2, 0.0, 2.0), ("glow", 1, 1, -0.5, 1.5), ("ootd", 1, 2, 0.0, 1.0)]
    assert got[0].time_bin == dt.datetime(2024, 1, 1, 12)
    assert timeseries.feature_counts(df, "tags", "t", ["1d"], strict_compat=True).filter("feature = 'glow'").first().unique_hashtags == 4
    with pytest.raises(ValueError):
        timeseries.time_bin(F.col("t"), "5m")
    week = spark.createDataFrame([(dt.datetime(2024, 1, 7, 5),), (dt.datetime(2024, 1, 8),)], "t timestamp").select(timeseries.time_bin(F.col("t"), "1w").alias("w")).collect()
    assert [r.w.day for r in week] == [1, 8]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 200), st.lists(st.sampled_from("abcd"), max_size=4)), max_size=25))
def test_counts_add_up(spark, posts):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(hours=h), tags) for h, tags in posts], "t timestamp, tags array<string>")
    got = timeseries.with_trend(timeseries.feature_counts(df, "tags", "t", ["6h"])).collect()
    assert sum(r["count"] for r in got) == sum(len(tags) for _, tags in posts)
    for f in {r.feature for r in got}:
        counts = [r["count"] for r in got if r.feature == f]
        assert all(min(counts) <= r.rolling_mean <= max(counts) for r in got if r.feature == f)


def test_standardise(spark):
    comments = spark.createDataFrame([("c1", None, "hi serum", "x", "2024-01-01 10:00:00"), ("c2", "c1", "", "3", "2024-01-01"), ("c3", "c1", "yo", "3", "no date"), ("c4", "c1", "ok", None, "2024-01-02")],
                                     "commentId string, parentCommentId string, textOriginal string, likeCount string, publishedAt string")
    got = {r.commentId: (r.engagement_score, r.is_reply) for r in standardise.standardise(comments).collect()}
    assert got == {"c1": (0.0, False), "c4": (0.0, True)}
    videos = spark.createDataFrame([("v", "Skincare", None, 100000, 5000, 800, 200, "2024-01-01")], "videoId string, title string, description string, viewCount long, likeCount long, commentCount long, favouriteCount long, publishedAt string")
    row = standardise.standardise(videos).first()
    assert row.text == "Skincare  " and row.engagement_score == pytest.approx(0.1 * 100000 + 2 * 5000 + 1.5 * 800 + 3 * 200)
    assert standardise.detect_dataset_type(["a"]) is None and standardise.standardise(spark.range(1)) is None
    assert standardise.detect_dataset_type(["textOriginal"]) == "comments" and standardise.detect_dataset_type(["title"]) == "videos"
    assert standardise.posts(comments, videos).count() == 3


def test_tfidf_limits(spark):
    df = spark.createDataFrame([("a", k, f"retinol serum number {k} works wonders") for k in range(4)], "g string, k int, t string")
    assert tfidf.term_scores(df, ["g"], "k", "t").count() == 0
    more = df.unionByName(spark.createDataFrame([("a", 9, "plain water works too my friend"), ("a", 10, None), ("a", 11, "")], "g string, k int, t string"))
    got = {r.term for r in tfidf.term_scores(more, ["g"], "k", "t").collect()}
    assert "retinol serum" in got and "works" not in got


def test_semantic(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (1, None)], "c int, v array<double>")
    got = {r.cluster_id: (r.size, round(r.coherence, 6)) for r in semantic.coherence(df, "c", "v").collect()}
    assert got == {1: (2, 0.0), 2: (1, 1.0)}
    row = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(semantic.cosine(F.col("a"), F.col("b")).alias("x"), semantic.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert row.x == pytest.approx(1.0) and row.y is None
    assert semantic.clusters(df.filter("c = 2"), "v", 5).count() == 1


def test_lookup(spark):
    df = spark.createDataFrame([("#Glass_Skin", True), ("été", True), ("a1", False), ("x-y", False), (None, False), ("", False)], "t string, w boolean")
    assert all(r.x == r.w for r in df.select(text.is_word_term(F.col("t")).alias("x"), "w").collect())
    terms = spark.createDataFrame([("a", "lip tint"), ("a", "tint"), ("b", "lip"), ("c", "hair")], "category string, term string")
    assert {(r.category, r.term) for r in lookup.fuzzy_lookup(terms, "Lip_Tint").collect()} == {("a", "lip tint"), ("b", "lip")}
    assert lookup.facets(terms, {"category": ["a"], "term": []}).count() == 2


def test_vocabulary(spark):
    terms = spark.createDataFrame([("Maskara ",), ("retinol",), ("serun",), (None,), ("",)], "t string")
    known = spark.createDataFrame([("serum", 5), ("serug", 9)], "word string, count long")
    got = {r.t: (r.corrected, r.was_corrected, r.method) for r in vocabulary.corrected(terms, "t", vocabulary=known).collect()}
    assert got["Maskara "] == ("mascara", True, "dictionary") and got["retinol"] == ("retinol", True, "dictionary") and got["serun"][0] == "serug"
    table = spark.createDataFrame([("rutina para la piel", "skin routine")], "term string, translation string")
    row = vocabulary.processed_terms(spark.createDataFrame([("rutina para la piel con una crema",), ("rutina para la piel",)], "t string"), "t", table).filter("translated").first()
    assert row.processed_term == "skin routine" and row.processing_steps == ["language", "translation"]


def test_nearest_word(spark):
    terms = spark.createDataFrame([("serum",), ("Xerum ",), ("erum",), ("seerum",), ("kerum",), ("eé",), ("maskarra",), ("sreum",)], "t string")
    known = spark.createDataFrame([("serum", 5), ("Serum", 5), ("zerum", 9), ("é", 7), ("maskara", 30)], "word string, count long")
    got = {r.t: (r.corrected, r.method) for r in vocabulary.corrected(terms, "t", vocabulary=known).collect()}
    assert got == {"serum": ("serum", "none"), "Xerum ": ("serum", "nearest"), "erum": ("serum", "nearest"), "seerum": ("serum", "nearest"),
                   "kerum": ("serum", "nearest"), "eé": ("é", "nearest"), "maskarra": ("maskarra", "none"), "sreum": ("sreum", "none")}
    twice = {r.t: r.corrected for r in vocabulary.corrected(terms, "t", vocabulary=known, distance=2).collect()}
    assert twice["sreum"] == "serum" and twice["maskarra"] == "maskarra"


def test_nearest_words_of_a_table(spark):
    import __spark_entry__ as entry

    def near(a, b):
        a, b = sorted((a, b), key=len)
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a == b or len(b) - len(a) < 2 and a[k + (len(a) == len(b)):] == b[k + 1:]

    folder = "/root/testdata/sf0.1"
    rows = [r.term for r in spark.read.parquet(f"{folder}/term_counts.parquet").collect() if r.term is not None]
    counts = Counter(t.strip(" ").lower() for t in rows)
    known = [(-n, w) for w, n in counts.items() if w and n >= vocabulary.KNOWN_ROWS and L.SPELLING.get(w, w) == w]
    nearest = {w: w if (-n, w) in known else min((k for k in known if near(w, k[1])), default=(0, w))[1] for w, n in counts.items() if w}
    low = lambda t: t.strip(" ").lower()
    want = {t: L.SPELLING.get(low(t)) or (nearest[low(t)] if low(t) and nearest[low(t)] != low(t) else t.strip(" ")) for t in rows}
    got = {r.term: r.corrected for r in entry.queries()["q_spelling_nearest"](spark, folder).collect()}
    assert got == want
    mapped = {r.original_term: r.processed_term for r in entry.queries()["q_term_pipeline_nearest"](spark, folder).collect()}
    assert mapped == want and sum(v != L.SPELLING.get(low(t), t.strip(" ")) for t, v in want.items()) > 0


def test_age(spark):
    df = spark.createDataFrame([("19 yo",), ("sixteen",), ("age 45",), ("boomer",), ("nothing",), (None,)], "t string")
    assert [r.g for r in df.select(classify.age_group(F.col("t"))["age_group"].alias("g")).collect()] == ["gen_z", "teen", "gen_x", "boomer", "unknown", "unknown"]


def test_forecast(spark):
    df = spark.createDataFrame([("a", 10.0, 0.5, dt.datetime(2024, 1, 1))], "f string, s double, r double, t timestamp")
    rows = timeseries.forecast(df, "s", "r", "t", 3).orderBy("step").collect()
    assert [r.value for r in rows] == [15.0, 22.5, 33.75] and str(rows[0].week) == "2024-01-14"


def test_zero_fill_and_dense(spark):
    df = spark.createDataFrame([("g", "2024-01-01", "a", 1.0), ("g", "2024-01-08", "b", 2.0)], "g string, w string, t string, v double")
    assert timeseries.zero_filled(df, "g", "w", "t", "v").count() == 4
    s = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1), ("a", dt.datetime(2024, 1, 4), 1)], "f string, t timestamp, n int")
    assert timeseries.densified(s, ["f"], "t", "n", "1d").count() == 4


def test_zero_fill_counts_weeks_without_terms(spark):
    series = spark.createDataFrame([("g", "2024-01-01", "a", 1.0), ("g", "2024-01-15", "b", 2.0)], "g string, w string, t string, v double")
    weeks = spark.createDataFrame([("g", f"2024-01-{d}") for d in ("01", "08", "08", "15", "22")] + [("h", "2024-01-01")], "g string, w string")
    got = sorted(tuple(r) for r in timeseries.zero_filled(series, "g", "w", "t", "v", weeks).select("t", "w", "v").collect())
    days = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    assert got == [("a", w, 1.0 if w == days[0] else 0.0) for w in days] + [("b", w, 2.0 if w == days[2] else 0.0) for w in days]


def test_lifecycle_counts_weeks_without_terms(spark):
    texts = [(dt.datetime(2024, 1, 1) + dt.timedelta(weeks=k), f"retinol serum skincare works post {n}") for k, size in enumerate((6, 2, 6, 1)) for n in range(size)]
    texts += [(dt.datetime(2024, 1, 1) + dt.timedelta(weeks=k), f"lovely skincare evening number {n}") for k in (0, 2) for n in range(3)]
    comments = spark.createDataFrame([(str(k), None, t, at) for k, (at, t) in enumerate(texts)], "commentId string, parentCommentId string, textOriginal string, publishedAt timestamp")
    got = pipeline.run(comments, config={"terms": {"least_posts": 5}, "lifecycle": {"least_appearances": 1}})["lifecycle"].filter("term = 'retinol serum'").first()
    assert (got.appearances, got.total_windows, got.latest_tfidf) == (2, 4, 0.0)


def test_empty_tables(spark):
    comments = spark.createDataFrame([], "commentId string, parentCommentId string, textOriginal string, publishedAt timestamp")
    stages = pipeline.run(comments)
    assert all(df.count() == 0 for df in stages.values())


def test_pipeline(spark):
    stages = pipeline.run(synthetic.synthetic_posts(spark, 1500), config={"terms": {"least_posts": 20}})
    assert stages["posts"].count() == 1350 and stages["weekly_terms"].count() > 0 and stages["lifecycle"].count() >= 0
    assert pipeline.merged({"terms": {"weekly_top": 3}})["terms"] == {"weekly_top": 3, "least_posts": 50, "least_per_window": 5}


def test_stream_equals_batch(spark, tmp_path):
    posts = synthetic.synthetic_posts(spark, 600).select("publishedAt", F.lit("x").alias("f"))
    posts.write.parquet(str(tmp_path / "in"))
    stream = bins.windowed_counts(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), "publishedAt", "f", "1 day")
    got = {r.time_bin: r["count"] for r in bins.drain(stream, "drained", str(tmp_path / "cp")).collect()}
    batch = {r.time_bin: r["count"] for r in timeseries.feature_counts(posts, "f", "publishedAt", ["1d"]).collect()}
    assert got and all(batch[t] == n for t, n in got.items()) and len(batch) - len(got) <= 2
    spans = bins.sessions(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), "publishedAt", "f", "2 hours")
    assert bins.drain(spans, "spans", str(tmp_path / "cp2")).count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "my_comments.csv").write_text("commentId,textOriginal\n1,hi\n2,\"a\nb\"\n")
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"title": "t", "m": {"n": 1}}]))
    found = files.discover(spark, str(tmp_path))
    assert len(found["comments"]) == 1 and len(found["videos"]) == 1
    assert set(files.read_any(spark, found["videos"][0]).columns) == {"title", "m.n"} and files.read_any(spark, found["comments"][0]).count() == 2
    assert {r.relative_path for r in files.catalogue(spark, str(tmp_path)).collect()} == {"a/my_comments.csv", "a/x.json"}
    assert files.csv_profile(spark, found["comments"][0], out=str(tmp_path / "s")).first().lines == 3
    assert files.all_csv_to_parquet(spark, str(tmp_path), str(tmp_path / "out")) and files.write_table(spark.range(0), str(tmp_path / "e"), skip_empty=True) is False
    files.markdown_report(files.catalogue(spark, str(tmp_path / "a")), str(tmp_path / "r.md"))
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        files.unzip(str(bad), str(tmp_path / "z"))
    with pytest.raises(ValueError):
        files.read_any(spark, "x.xyz")


def test_reports_round_trip(spark, tmp_path):
    weekly = spark.createDataFrame([("a", dt.date(2024, 1, 1), "t", 0.5), ("a", dt.date(2024, 1, 8), "u", 0.25)], "category string, window_start date, term string, tfidf_score double")
    path = str(tmp_path / "r.json")
    files.nested_trends(weekly, path)
    assert sorted(files.weekly_trends(spark, path).collect()) == sorted(weekly.collect())
    inner = {"hair": {"bob": {"trend_state": "Stable", "decay_confidence": 0.0}}}
    for k, body in enumerate((inner, {"term_decay_analysis": inner, "methodology": {}})):
        (tmp_path / f"d{k}.json").write_text(json.dumps(body))
        assert files.decay_report(spark, str(tmp_path / f"d{k}.json")).filter("term = 'bob'").first().trend_state == "Stable"


def test_plans(spark):
    df = spark.createDataFrame([("Maskara",)], "t string")
    assert "BroadcastHashJoin" in vocabulary.corrected(df, "t")._jdf.queryExecution().executedPlan().toString()


def test_hooks(spark):
    from tidemark.functions import hooks

    df = spark.createDataFrame([("abc",), (None,), (" ",)], "t string")
    got = [tuple(r.x) for r in df.select(hooks.labelled_by(lambda ts: [(t.upper(), 0.5) for t in ts], F.col("t"), ("blank", 0.0), 2).alias("x")).collect()]
    assert got == [("AB", 0.5), ("blank", 0.0), ("blank", 0.0)]
    vectors = df.select(hooks.embedded_by(lambda ts: [[len(t), 1] for t in ts], F.col("t")).alias("v"))
    assert [tuple(r) for r in vectors.select(*hooks.vector_columns("v", 3, "e")).collect()] == [(3.0, 1.0, None), (0.0, 1.0, None), (1.0, 1.0, None)]


def test_stages_are_queries(spark):
    import __spark_entry__ as entry

    got = entry.queries()["q_stage_candidates"](spark, "/root/testdata/sf0.001")
    rows = got.select("interval", "feature_type", "time_bin", "rate_of_change").collect()
    assert {(r.interval, r.feature_type) for r in rows} == {(i, f) for i in ("1h", "6h") for f in ("hashtags", "tokens")}
    assert all((a.time_bin, -a.rate_of_change) <= (b.time_bin, -b.rate_of_change) for a, b in zip(rows, rows[1:]))


def test_vector_columns_hold_whole_vectors(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    lengths = {r.n for r in spark.read.parquet(f"{folder}/embeddings.parquet").select(F.size("embedding").alias("n")).distinct().collect()}
    assert max(lengths) == len(entry.queries()["q_vector_columns_all"](spark, folder).columns) - 1


def test_command_line(spark, tmp_path):
    from tidemark.__main__ import main

    synthetic.synthetic_posts(spark, 400).write.parquet(str(tmp_path / "in" / "comments.parquet"))
    (tmp_path / "c.json").write_text(json.dumps({"series": {"intervals": ["1d"]}}))
    report = main([str(tmp_path / "in"), str(tmp_path / "out"), "--config", str(tmp_path / "c.json")])
    assert report["rows"]["posts"] == 360 and report["rows"]["series"] > 0 and report["config"]["series"]["features"] == ["hashtags", "tokens"]
    assert (tmp_path / "out" / "report.json").exists()


def test_clean_is_five_steps(spark):
    """Three passes give what emoji, addresses, names, signs and gaps give one after another."""
    rng = random.Random(1)
    bits = [*"aAb\u00e9 _#@.:/!? \n\t", "http://", "https://", "www.", "HTTPS://", "\U0001f600", "\u7f8e", "\u24c2", "\u2702", "\u00df", "\u0967", "@x", "\u00a0", "\u2003", "\x85", "\x1c"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))),) for _ in range(5000)] + [(None,), ("x" * 100_000 + "@" * 100_000,)]
    out = F.lower(F.coalesce(F.col("t"), F.lit("")))
    for pattern in (L.EMOJI, f"(?i){L.URL}", L.MENTION, L.SPECIAL, L.GAP):
        out = F.regexp_replace(out, pattern, " ")
    df = spark.createDataFrame(rows, "t string").select(F.trim(out).alias("a"), text.clean(F.col("t")).alias("b"))
    assert df.filter("not a <=> b").count() == 0


def test_posts_are_cleaned_once(spark):
    df = spark.createDataFrame([("comments", "v", dt.datetime(2024, 1, 1), "Glow SERUM!", 1.0)], "dataset_type string, video_id string, timestamp timestamp, text string, engagement_score double")
    plan = standardise.processed(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") <= 3 and standardise.processed(df).first().category == "skincare"
    assert standardise.processed(df.limit(0)).count() == 0


def test_age_indicators(spark):
    rows = [("19 YO, gen z college student; age 21",), (None,), ("",), ("middle aged, baby boomer",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(classify.age_indicators(F.col("t")).alias("x")).collect()]
    assert got[0].indicators == ["19 yo", "21", "gen z", "college", "student"] and got[0].numeric_ages == [19, 21] and got[0].age_group == "gen_z"
    assert got[1].age_group == "unknown" and got[1].indicators == [] and got[1].numeric_ages == [] and got[2].indicators == []
    assert got[3].indicators == ["boomer", "middle aged"] or got[3].indicators == ["baby boomer", "middle aged"]


def test_registry(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame([(["glow", "serum"],)], "w array<string>")
    model = Pipeline(stages=[HashingTF(inputCol="w", outputCol="v", numFeatures=16)]).fit(df)
    words = spark.createDataFrame([("glow", 0.5)], "term string, weight double")
    files.save_model(model, words, str(tmp_path / "m"), {"terms": 1, "made": "today"})
    loaded, vocabulary_, facts = files.load_model(spark, str(tmp_path / "m"))
    assert facts == {"terms": 1, "made": "today"} and vocabulary_.collect() == words.collect()
    assert loaded.transform(df).first().v == model.transform(df).first().v


def test_profile_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a")], "k int, t string")
    df.write.parquet(str(tmp_path / "in" / "comments.parquet"))
    df.coalesce(1).write.csv(str(tmp_path / "in" / "deep" / "posts.csv"), header=True)
    assert files.tables_below(spark, str(tmp_path / "in"), (".parquet", ".csv")) == [str(tmp_path / "in" / "comments.parquet"), str(tmp_path / "in" / "deep" / "posts.csv")]
    assert {(r.column, r.rows, r.nulls, r.distinct_values) for r in files.table_profile(df).collect()} == {("k", 3, 0, 2), ("t", 3, 1, 1)}
    files.profile_report(spark, str(tmp_path / "in"), str(tmp_path / "report.md"))
    assert "| t | string | 3 | 1 | 1 |" in (tmp_path / "report.md").read_text()
    assert files.all_csv_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out")) == [str(tmp_path / "out" / "deep" / "posts.parquet")]


def test_redelivered_comments_are_documents(spark):
    at = dt.datetime(2024, 1, 3)
    rows = [(f"c{k}", None, "v", "u", "the night serum works wonders", 1, at) for k in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "commentId string, parentCommentId string, videoId string, authorId string, textOriginal string, likeCount long, publishedAt timestamp")
    stages = pipeline.run(df)
    assert stages["posts"].select("post_key").distinct().count() == 65

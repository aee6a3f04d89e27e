"""SQL that states each query again, on the tables as they are, for comparison in another engine."""

from __future__ import annotations

from tidemark.functions import lexicon as L
from tidemark.operators.vocabulary import VOTES


def text(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def in_list(words) -> str:
    return ", ".join(text(w) for w in words)


def holds(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def held(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {text(w)}) AS INTEGER)" for w in words) + ")"


def replaced(column: str, *patterns: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, {text(p)}, ' ', 'g')"
    return column


def clean(column: str) -> str:
    return f"trim({replaced(f'lower(coalesce({column}, {text('')}))', L.EMOJI, '(?i)' + L.URL, L.MENTION, L.SPECIAL, L.GAP)})"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def category(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {holds(f'lower({column})', ws)} THEN {text(c)}" for c, ws in L.CATEGORY_KEYWORDS.items()) + " END"


ALL_KEYWORDS = sorted({w for ws in L.CATEGORY_KEYWORDS.values() for w in ws})

COMMENTS = """
comments_std AS (
  SELECT *, publishedAt AS ts, textOriginal AS txt, coalesce(CAST(likeCount AS DOUBLE), 0) AS engagement, parentCommentId IS NOT NULL AS reply
  FROM comments WHERE publishedAt IS NOT NULL AND length(textOriginal) > 0)"""
ENGAGEMENT = "(CAST(0.1 AS DOUBLE) * coalesce(viewCount, 0) + CAST(2.0 AS DOUBLE) * coalesce(likeCount, 0) + CAST(1.5 AS DOUBLE) * coalesce(commentCount, 0) + CAST(3.0 AS DOUBLE) * coalesce(favouriteCount, 0))"
VIDEOS = f"""
videos_std AS (
  SELECT *, publishedAt AS ts, coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(tags, '') AS txt, {ENGAGEMENT} AS engagement
  FROM videos WHERE publishedAt IS NOT NULL AND length(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(tags, '')) > 0)"""
POSTS = f"""{COMMENTS}, {VIDEOS},
posts AS (
  SELECT 'comments' AS dataset_type, videoId AS video_id, ts, txt, engagement FROM comments_std
  UNION ALL SELECT 'videos', videoId, ts, txt, engagement FROM videos_std),
relevant AS (SELECT *, {clean('txt')} AS cleaned FROM posts WHERE {holds('lower(txt)', ALL_KEYWORDS)}),
processed AS (SELECT * FROM (SELECT *, {category('cleaned')} AS category FROM relevant) WHERE category IS NOT NULL),
numbered AS (SELECT *, row_number() OVER () AS k FROM processed)"""


def time_bin(interval: str, column: str = "ts") -> str:
    if interval == "1w":
        return f"date_trunc('week', {column})"
    seconds = {"1h": 3600, "6h": 21600, "1d": 86400}[interval]
    return f"make_timestamp(CAST(floor(epoch({column}) / {seconds}) AS BIGINT) * {seconds} * 1000000)"


TAGGED = f"""{POSTS},
tagged AS (SELECT k, ts, video_id, lower(unnest(regexp_extract_all(txt, {text(L.HASHTAG)}, 1))) AS feature FROM numbered)"""


def series(interval: str) -> str:
    return f"""{TAGGED},
series AS (SELECT {time_bin(interval)} AS b, feature, count(*) AS n FROM tagged GROUP BY 1, 2),
trend AS (
  SELECT b, feature, n, avg(n) OVER (PARTITION BY feature ORDER BY b ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mean,
    coalesce(CAST(n - lag(n) OVER (PARTITION BY feature ORDER BY b) AS DOUBLE) / lag(n) OVER (PARTITION BY feature ORDER BY b), 0) AS rate
  FROM series)"""


EVENTS = f"""
binned AS (SELECT event_type AS feature, {time_bin('1d')} AS b, count(*) AS n FROM events GROUP BY 1, 2),
grown AS (SELECT *, n - lag(n) OVER (PARTITION BY feature ORDER BY b) AS g FROM binned),
diffs AS (SELECT *, g - lag(g) OVER (PARTITION BY feature ORDER BY b) AS a, row_number() OVER (PARTITION BY feature ORDER BY b DESC) AS back, count(*) OVER (PARTITION BY feature) AS rows_ FROM grown),
v1 AS (
  SELECT feature, bool_and(g > 0) FILTER (back <= 3) AS up, bool_and(g < 0) FILTER (back <= 3) AS down, bool_and(coalesce(a < 0, false)) FILTER (back <= 3) AS slowing,
    coalesce(bool_or(a > 0) FILTER (back <= 3), false) AS faster, avg(g) FILTER (back <= 3) AS mg, avg(a) FILTER (back <= 3) AS ma,
    avg(g) AS avg_growth, avg(a) AS avg_acceleration, CAST(arg_max(n, b) - arg_min(n, b) AS BIGINT) AS total_change,
    CAST(arg_max(g, b) AS BIGINT) AS latest_growth, CAST(arg_max(a, b) AS BIGINT) AS latest_acceleration
  FROM diffs WHERE rows_ > 3 GROUP BY feature),
states AS (
  SELECT *, CASE WHEN up AND slowing THEN 'Decaying' WHEN up AND faster THEN 'Accelerating' WHEN up THEN 'Growing' WHEN down THEN 'Declining' ELSE 'Stable' END AS trend_state,
    CASE WHEN up AND slowing THEN least(1.0, abs(ma) / greatest(mg, 0.001)) ELSE 0.0 END AS decay_confidence FROM v1)"""


def scores(part: list[str], source: str) -> str:
    """``source`` gives the part's columns, doc and txt."""
    p = ", ".join(part)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in part) or "true"
    by = f"PARTITION BY {p}" if part else ""
    pc = p + ", " if part else ""
    bare = f"regexp_replace(regexp_replace(lower(txt), {text(L.TERM_NOISE)}, '', 'g'), {text(L.TERM_SPECIAL)}, ' ', 'g')"
    return f"""
docs AS ({source}),
long AS (SELECT * FROM docs WHERE length(trim(txt)) > 10),
sizes AS (SELECT {pc}count(DISTINCT doc) AS nd FROM long {'GROUP BY ' + p if part else ''} HAVING count(DISTINCT doc) >= 5),
lists AS (SELECT {pc}doc, regexp_extract_all({bare}, {text(L.TERM_TOKEN)}) AS ws FROM long),
words AS (SELECT {pc}doc, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lists),
kept_words AS (SELECT * FROM words WHERE w NOT IN ({in_list(L.STOP_WORDS)})),
pairs AS (SELECT *, lead(w) OVER (PARTITION BY {pc}doc ORDER BY pos) AS nxt FROM kept_words),
tf AS (SELECT {pc}doc, term, count(*) AS tf FROM (
  SELECT {pc}doc, w AS term FROM pairs UNION ALL SELECT {pc}doc, w || ' ' || nxt FROM pairs WHERE nxt IS NOT NULL) GROUP BY {pc}doc, term),
terms AS (SELECT {', '.join('t.' + x for x in part) + ', ' if part else ''}term, count(*) AS df, sum(tf) AS total, any_value(nd) AS nd FROM tf t JOIN sizes s ON {on('t', 's')} GROUP BY {', '.join('t.' + x for x in part) + ', ' if part else ''}term),
good AS (SELECT *, row_number() OVER ({by} ORDER BY total DESC, term) AS r FROM terms WHERE df >= 2 AND df <= CAST(0.8 AS DOUBLE) * nd),
weights AS (SELECT {', '.join('t.' + x for x in part) + ', ' if part else ''}t.doc, t.term, df, nd, tf * (ln((1 + nd) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf t JOIN good g ON {on('t', 'g')} AND t.term = g.term AND r <= 1000),
norms AS (SELECT {pc}doc, sqrt(sum(w * w)) AS norm FROM weights GROUP BY {pc}doc),
scored AS (SELECT {', '.join('a.' + x for x in part) + ', ' if part else ''}term, sum(w / norm) / any_value(nd) AS tfidf_score FROM weights a JOIN norms b ON {on('a', 'b')} AND a.doc = b.doc GROUP BY {', '.join('a.' + x for x in part) + ', ' if part else ''}term),
ranked AS (SELECT *, row_number() OVER ({by} ORDER BY round(tfidf_score, 12) DESC, term) AS rank FROM scored WHERE tfidf_score > 0)"""


WEEKLY = scores(["category", "week"], "SELECT category, CAST(date_trunc('week', \"timestamp\") AS DATE) AS week, post_id AS doc, cleaned_text AS txt FROM processed_posts WHERE category IS NOT NULL AND \"timestamp\" IS NOT NULL") + """,
weekly AS (SELECT * FROM ranked WHERE rank <= 10)"""
FILLED = f"""{WEEKLY},
filled AS (
  SELECT t.category, w.week, t.term, coalesce(x.tfidf_score, 0) AS score FROM (SELECT DISTINCT category, term FROM weekly) t
  JOIN (SELECT DISTINCT category, week FROM weekly) w ON t.category = w.category
  LEFT JOIN weekly x ON x.category = t.category AND x.term = t.term AND x.week = w.week)"""
V2 = f"""{FILLED},
fg AS (SELECT *, round(score - lag(score) OVER (PARTITION BY category, term ORDER BY week), 12) AS g, score - lag(score) OVER (PARTITION BY category, term ORDER BY week) AS g0 FROM filled),
fa AS (SELECT *, round(g0 - lag(g0) OVER (PARTITION BY category, term ORDER BY week), 12) AS a, row_number() OVER (PARTITION BY category, term ORDER BY week DESC) AS back, count(*) OVER (PARTITION BY category, term) AS n FROM fg),
v2a AS (SELECT category, term, any_value(n) AS n, round(avg(g) FILTER (back <= 3), 12) AS mg, round(avg(a) FILTER (back <= least(3, n - 2)), 12) AS ma,
  CAST(count(*) FILTER (back <= least(3, n - 2) AND g > 0 AND a < 0) AS DOUBLE) / least(3, any_value(n) - 2) AS sure FROM fa GROUP BY 1, 2),
v2 AS (SELECT category, term, CASE WHEN n < 4 THEN 'Insufficient_Data' WHEN mg > 0 AND ma < 0 THEN 'Decaying' WHEN mg > 0 AND ma > 0 THEN 'Accelerating' WHEN mg > 0 AND abs(ma) < 0.01 THEN 'Growing'
  WHEN abs(mg) < 0.01 THEN 'Stable' ELSE 'Declining' END AS trend_state, CASE WHEN n < 4 THEN 0.0 ELSE sure END AS decay_confidence, CASE WHEN n < 4 THEN 0.0 ELSE mg END AS avg_growth_rate FROM v2a),
stats AS (SELECT category, term, count(*) FILTER (score > 0) AS appearances, count(*) AS total_windows, max(score) AS max_tfidf, min(score) AS min_tfidf, arg_max(score, week) AS latest_tfidf
  FROM filled GROUP BY 1, 2 HAVING count(*) FILTER (score > 0) >= 5)"""

NAME = "trim(translate(replace(lower(term), '#', ''), '_', ' '))"

_votes = {lang: "(" + " + ".join(f"CAST(list_contains(ws, {text(w)}) AS INTEGER)" for w in words) + ")" for lang, words in VOTES.items()}
_top = f"greatest({', '.join(_votes.values())})"
LANGUAGE = f"CASE WHEN coalesce(trim(corrected), '') = '' THEN 'unknown' " + " ".join(f"WHEN {v} = {_top} AND {_top} > 0 THEN {text(k)}" for k, v in _votes.items()) + " ELSE 'en' END"
SPELLING = "(VALUES " + ", ".join(f"({text(a)}, {text(b)})" for a, b in sorted(L.SPELLING.items())) + ") AS d(k, v)"


def age(column: str) -> str:
    ages = "list_concat(" + ", ".join(f"regexp_extract_all(lower({column}), {text(p)}, 1)" for p in L.AGES) + ")"
    mean = f"list_avg(CAST({ages} AS INTEGER[]))"
    by_age = "CASE " + " ".join(f"WHEN {mean} <= {n} THEN {text(g)}" for n, g in L.AGE_LIMITS) + " ELSE 'boomer' END"
    by_word = "CASE " + " ".join(f"WHEN {holds(f'lower({column})', ws)} THEN {text(g)}" for g, _, ws in L.AGE_CASCADE) + " ELSE 'unknown' END"
    return f"CASE WHEN coalesce(len({ages}), 0) > 0 THEN {by_age} ELSE {by_word} END"


def indicators(column: str) -> str:
    """What each pattern finds, in the order of the patterns; of the first one its number and its unit."""
    found = lambda p, k: f"regexp_extract_all(lower({column}), {text(p)}, {k})"
    first, *others = L.AGE_PATTERNS
    stated = f"list_transform(list_zip({found(first, 1)}, {found(first, 2)}), lambda x: x[1] || ' ' || x[2])"
    return "list_concat(" * len(others) + stated + "".join(f", {found(p, 1)})" for p in others)


def numbers(column: str) -> str:
    return f"list_transform(list_concat(regexp_extract_all(lower({column}), {text(L.AGE_PATTERNS[0])}, 1), regexp_extract_all(lower({column}), {text(L.AGE_PATTERNS[1])}, 1)), lambda x: CAST(x AS INTEGER))"


def drawn(column: str, salt: str, seed: int = 7) -> str:
    """The number that synthetic.drawn gives."""
    return f"CAST('0x' || substr(md5({column} || '|{seed}|{salt}'), 1, 7) AS BIGINT)"


#: The nearest known word within one edit of each term that the dictionary doesn't hold. Letters are compared, not bytes.
NEAREST = f"""
known AS (SELECT lower(trim(term)) AS near, count(*) AS c FROM term_counts WHERE lower(trim(term)) <> '' GROUP BY 1 HAVING count(*) >= 20),
known_words AS (SELECT * FROM known WHERE near NOT IN (SELECT k FROM {SPELLING} WHERE k <> v)),
keys AS (SELECT DISTINCT lower(trim(term)) AS key FROM term_counts WHERE lower(trim(term)) <> '' AND lower(trim(term)) NOT IN (SELECT k FROM {SPELLING})),
key_parts AS (SELECT key, i, substr(key, 1, i - 1) || substr(key, i + 1) AS part FROM (SELECT key, unnest(range(1, length(key) + 1)) AS i FROM keys)),
word_parts AS (SELECT near, c, i, substr(near, 1, i - 1) || substr(near, i + 1) AS part FROM (SELECT near, c, unnest(range(1, length(near) + 1)) AS i FROM known_words)),
within AS (
  SELECT key, near, c, 0 AS d FROM keys JOIN known_words ON key = near
  UNION ALL SELECT key, near, c, 1 FROM key_parts a JOIN word_parts b ON a.i = b.i AND a.part = b.part AND length(key) = length(near) AND key <> near
  UNION ALL SELECT key, near, c, 1 FROM key_parts JOIN known_words ON part = near
  UNION ALL SELECT key, near, c, 1 FROM keys JOIN word_parts ON part = key),
nearest AS (SELECT key, near FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, c DESC, near) AS r FROM within) WHERE r = 1 AND near <> key)"""


def with_nearest(sql: str) -> str:
    """A query that applies the dictionary, with the nearest known word after it."""
    sql = sql.replace(f"{SPELLING} ON lower(trim(term)) = k", f"{SPELLING} ON lower(trim(term)) = k LEFT JOIN nearest ON v IS NULL AND key = lower(trim(term))")
    sql = sql.replace("coalesce(v, trim(term))", "coalesce(v, near, trim(term))").replace("v IS NOT NULL", "(v IS NOT NULL OR near IS NOT NULL)")
    return f"WITH {NEAREST}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {NEAREST} {sql}"

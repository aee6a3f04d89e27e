"""The corpus operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import datetime as dt
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import DATA, compare, views
from tidemark.llm import canonical, chunking, frequency, glyphs, language, leakage, lookalike, mixing, subjects, tokens

Q = entry.queries()


def read(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{DATA}/{name}.parquet")


@pytest.mark.parametrize("name", ["p4_found", "p4_counts"])
def test_sql(spark, name):
    assert not compare(spark, name, Q[name], entry.oracle_sql()[name], DATA, views(DATA))


@pytest.mark.parametrize("name", sorted(n for n in Q if n.startswith("p")))
def test_runs(spark, name):
    Q[name](spark, DATA).count()


# Look-alikes

def test_skeleton():
    assert glyphs.skeleton("ｆｕｌｌ  wіdtһ café z​ero ﬁn") == glyphs.skeleton("full width café zero fin")
    assert glyphs.skeleton("café") != glyphs.skeleton("cafe") and glyphs.skeleton("a1") != glyphs.skeleton("al")
    assert glyphs.by_table("привeт") == "привет" and glyphs.by_table("рaypal") == "paypal"


def test_capitals():
    assert glyphs.skeleton("СОРРЕR Ѕhор") == glyphs.skeleton("COPPER Shop") and glyphs.by_table("ДOМ") == "ДОМ"
    assert lookalike.settle(["MOCKBA", "И", "ДОМ"]) == "МОСКВА И ДОМ"


def test_linear_tests(spark):
    """One word of a million letters, in one script and in two."""
    began = time.perf_counter()
    words = ["a" * 1_000_000, "b" * 999_999 + "ж", "aж" * 500_000]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, t string")
    assert [r.s for r in df.select("k", lookalike._stable(F.col("t")).alias("s")).orderBy("k").collect()] == [True, False, False]
    assert time.perf_counter() - began < 20


def test_classes(spark):
    texts = ["so good", "ѕо good", "so good", "sо gооd", "so bad", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, cleaned_text string")
    got = {r.id: r.links for r in lookalike.lookalike_classes(lookalike.canonical_texts(df)).collect()}
    assert got == {0: 2, 1: 3, 2: 2, 3: 3}
    # A spelling that repeats without end: each row's links and the pairs tell the same.
    many = spark.range(600).select(F.col("id").alias("post_id"), F.when(F.col("id") % 3 == 0, "glоw").otherwise("glow").alias("cleaned_text"))
    canon = lookalike.canonical_texts(many)
    assert lookalike.lookalike_pairs(canon).count() == 200 * 400
    assert lookalike.lookalike_classes(canon).groupBy("links").count().orderBy("links").collect() == [(200, 400), (400, 200)]


def test_plain_keys(spark):
    words = sorted({w for t in read("processed_posts").cleaned_text.dropna() for w in t.split()})
    df = spark.createDataFrame([(w,) for w in words], "word string").filter(lookalike._plain(F.col("word")))
    assert df.count() > 500 and df.filter(lookalike._plain_key(F.col("word")) != lookalike._key("word")).count() == 0


def test_trie():
    trie = lookalike.Trie()
    for w, n in (("serum", 5), ("café", 2), ("serom", 1)):
        trie.add(w, n)
    assert [w for _, w, _ in trie.reach("ѕе​rum")] == ["serum"]
    assert [w for _, w, _ in trie.reach("café")] == ["café"] and trie.reach("cafe") == []
    assert {w for _, w, _ in trie.reach("serum", 1)} == {"serum", "serom"} and trie.reach("sorom", 1)[0][:2] == (1, "serom")


def test_pairs(spark):
    texts = ["so good", "ѕо good", "so good", "so good", "so god", "sо gо​оd", None, "", " ", "не берите у вас", "не берите y вас", "не берите у вас", "с а", "c a"]
    rows = [(k, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "post_id long, cleaned_text string, id long")
    canon = {r.id: r.canonical for r in lookalike.canonical_texts(df).collect()}
    assert len(canon) == len(texts) and canon[6] is None and canon[7] == canon[8] == "" and canon[1] == "so good" and canon[10] == "не берите у вас"
    got = {(r.id_a, r.id_b) for r in lookalike.lookalike_pairs(lookalike.canonical_texts(df)).collect()}
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and x and y and x.strip() and x != y and glyphs.skeleton(x) == glyphs.skeleton(y)}
    assert got == want and (0, 1) in got and (0, 3) not in got
    assert lookalike.lookalike_pairs(lookalike.canonical_texts(df.limit(0))).count() == 0


def test_long_text(spark):
    long = "word " * 60_000 + "ѕ"
    df = spark.createDataFrame([(1, long), (2, "word " * 60_000 + "s")], "post_id long, cleaned_text string")
    assert lookalike.lookalike_pairs(lookalike.canonical_texts(df)).count() == 1


def test_pairs_against_brute_force(spark):
    posts = read("processed_posts")[["post_id", "cleaned_text"]].dropna()
    want = set()
    for _, group in posts.assign(k=posts.cleaned_text.map(glyphs.skeleton)).groupby("k"):
        for a, x in zip(group.post_id, group.cleaned_text):
            want |= {(a, b) for b, y in zip(group.post_id, group.cleaned_text) if a < b and x != y}
    assert {(r.post_id_a, r.post_id_b) for r in Q["p2_found"](spark, DATA).collect()} == want


# Languages

def test_labels():
    same = {"en": ["en", "EN", "en-US", "en_GB", "eng", "English", " english "], "de": ["deu", "ger", "Deutsch", "de-AT"], "fr": ["fr-CA", "Français"]}
    assert all(language.label_code(x) == c for c, xs in same.items() for x in xs)
    assert all(language.label_code(x) is None for x in (None, "", " ", "und", "unknown", "n/a", "zxx"))


def test_network_on_held_out_samples():
    samples = read("language_samples")
    held = samples.sample(frac=0.25, random_state=1)
    rest = samples.drop(held.index)
    net = language.train(list(zip(rest["lang"], rest["sample"])))
    got = net.stretches([language.letters(t) for t in held["sample"]])
    right = np.mean([len(g) == 1 and g[0][0] == lang for g, lang in zip(got, held["lang"])])
    assert right >= 0.9
    assert net.stretches(["", "x"])[0] == [] and len(net.stretches(["x"])[0]) == 1
    rng = random.Random(2)
    clean = {c: g["sample"].tolist() for c, g in rest.groupby("lang")}
    mixed = [rng.sample(sorted(clean), 2) for _ in range(60)]
    read_ = net.stretches([language.letters(" ".join(rng.choice(clean[c]) for c in pair)) for pair in mixed])
    assert np.mean([[s[0] for s in got] == pair for got, pair in zip(read_, mixed)]) >= 0.85


def test_segments(spark):
    samples = spark.createDataFrame(read("language_samples"))
    texts = [(1, "en", "i keep coming back to the night serum before work"), (1, "en", "i keep coming back to the night serum before work"), (2, "fr", None), (3, None, ""), (4, "ru", "me too"), (None, "en", "no id here at all you see")]
    df = spark.createDataFrame(texts, "k long, l string, t string")
    rows = language.language_segments(df, samples, "k", "t", "l", 5).collect()
    assert [(r.record_id, r.segment_no, r.lang, r.label_right) for r in rows] == [(1, 1, "en", True)] * 2 and all(0 <= r.confidence <= 1 for r in rows)
    assert language.language_segments(df, samples.limit(0), "k", "t", "l", 5).count() == 0


def test_words_aside_from_hashtags(spark):
    samples = spark.createDataFrame(read("language_samples"))
    texts = [(1, "xx", "this is four words #tag #more", 5), (2, "xx", "this is four words #tag", 4), (3, "xx", "now here are five words #tag", 5)]
    df = spark.createDataFrame(texts, "k long, l string, t string, n int")
    assert {r.record_id for r in language.language_segments(df, samples, "k", "t", "l", F.col("n")).collect()} == {2, 3}


def test_stretches_cover_the_text():
    net = language.train([(c, s) for c, s in zip(read("language_samples")["lang"], read("language_samples")["sample"])], windows=4_000)
    text = "i keep coming back to the night serum " + "мне понравилось видео про шерстяное пальто " + "je ne pensais pas que la robe serait aussi utile ok no"
    for got in net.stretches([text, text[:60], "ok да si", text * 5]):
        assert got[0][2] == 0 and all(a[3] == b[2] and a[0] != b[0] for a, b in zip(got, got[1:]))
    assert net.stretches([text])[0][-1][3] == len(text.encode())


def test_training_repeats():
    pairs = list(zip(read("language_samples")["lang"], read("language_samples")["sample"]))
    a, b = (language.train(p, windows=1_000) for p in (pairs, list(pairs)))
    assert all((x == y).all() for x, y in zip([*a.conv, a.out], [*b.conv, b.out])) and np.allclose(a.out, np.round(a.out, language.PLACES), atol=1e-7)
    assert language.network(pairs[:20], []) is language.network(list(pairs[:20]), [])


# Frequencies

def test_heavy_changes_nothing(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, " Glow" if k % 3 else f"t{k % 40}", k % 7 - 1, at) for k in range(600)] + [(1, "glow", 99, at + dt.timedelta(1)), (2, None, 5, at), (3, " ", 5, at), (None, "glow", None, None), (5, "glow", 3, None)]
    df = spark.createDataFrame(rows, "term_id long, term string, count long, loaded_at timestamp")
    counts = [sorted(map(tuple, frequency.term_frequencies(df, "term_id", "term", "count", "loaded_at", s).collect())) for s in (0.9, 0.1, 0.001)]
    assert counts[0] == counts[1] == counts[2]
    latest = {}
    for i, t, c, when in rows:
        key = i if i is not None else object()
        if key not in latest or ((when is not None, when or at, c or 0)) > latest[key][0]:
            latest[key] = ((when is not None, when or at, c or 0), t, c)
    want = {}
    for _, t, c in latest.values():
        if t and t.strip():
            n, s = want.get(t.strip().lower(), (0, 0))
            want[t.strip().lower()] = (n + 1, s + max(0, c or 0))
    assert {t: (n, s) for t, n, s in counts[0]} == want
    assert frequency.marked(frequency.term_frequencies(df.limit(0), "term_id", "term", "count", "loaded_at")).count() == 0


# Canonical entries

LIST = [(1, "Maison Opulmwy", "brand"), (2, "Opulmwy Crème Légère", "product"), (3, "Opulmwy Curl Cream", "product"), (4, "Zubeltor Lab", "brand"), (5, "Zubeltor Brow Gel", "product"), (6, "Maison Kyamvex", "brand"), (7, "Maison Ulmzuwen", "brand"), (8, "Kyamvex Day Fluid", "product")]


def test_canonical():
    index = canonical.Index(LIST)
    best = lambda v: next((i for _, i, named in index.best(v)[:1] if named), -1)
    typed = {"OPULMWY": 1, "new opulmwy!!": 1, "opulmwy creme legere": 2, "OpulmwyCurlCream": 3, "curl cream by opulmwy": 3, "subeltor lab": 4, "#Zubeltor-Brow-Gel": 5, "zubletor brow gel": 5, "kiamvex dai fluid": 8, "Maison Kyamvx": 6}
    assert {v: best(v) for v in typed} == typed
    assert all(best(v) == -1 for v in ("brow gel", "jorenti brow gel", "????", "same as hers", "", "my new"))


def test_many_entries_of_one_type():
    others = ["Abdorin", "Ekvalt", "Uphensk", "Ostrigam", "Ilmendar", "Yrsafeth", "Hjonvik", "Draskoff", "Fenwhil"]
    entries = [(k, f"{b} tinted lip balm velvet matte", "product") for k, b in enumerate(others)]
    entries += [(k + 20, b, "brand") for k, b in enumerate(others)] + [(50, "Zuqo", "brand"), (51, "Zuqo tinted lip balm", "product")]
    assert canonical.Index(entries).best("tinted lip balm zuqo")[0][1:] == (51, True)


def test_blocks_change_nothing(spark, monkeypatch):
    values = spark.createDataFrame([(v,) for v in ("new opulmwy!!", "opulmwy creme legere", "curl cream by opulmwy", "zubletor brow gel", "Maison Kyamvx", "brow gel")], "v string")
    listed = spark.createDataFrame(LIST, "i long, n string, k string")
    found = lambda: sorted((r.value, r.canon_id, round(r.score, 6)) for r in canonical.map_values(values, listed, "v", "i", "n", "k").collect())
    one = found()
    monkeypatch.setattr(canonical, "BLOCK", 3)
    assert found() == one


def test_map_values(spark):
    values = spark.createDataFrame([("kyamvex",), ("kyamvex",), (None,), ("  ",), ("x",)], "v string")
    listed = spark.createDataFrame([*LIST, (99, "Maison Kyamvex", "brand"), (None, "Nobody", "brand")], "i long, n string, k string")
    got = {r.value: r.canon_id for r in canonical.map_values(values, listed, "v", "i", "n", "k").collect()}
    assert got == {"kyamvex": 6, "x": -1}
    assert {r.canon_id for r in canonical.map_values(values, listed.limit(0), "v", "i", "n", "k").collect()} == {-1}


# Leaks

def test_leaks(spark):
    items = read("eval_items")
    passage = items.passage.iloc[3]
    words = passage.split()
    other = " ".join(str(int(w) + 7) if w.isdigit() else w for w in words)
    for k in range(len(words)):
        if k % 9 == 4:
            words[k] = "banana"
    half = passage.split()[: len(passage.split()) * 6 // 10]
    texts = ["filler words here " * 30 + passage.upper().replace(" ", "\n"), " ".join(words), " ".join(half), " ".join(passage.split()[:9]), "nothing of that kind " * 50, None, "", other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, spark.createDataFrame(items)).collect()}
    item = int(items.item_id.iloc[3])
    assert {(0, item), (1, item), (2, item)} <= got and not {d for d, _ in got} & {3, 4, 5, 6}
    assert leakage.find_leaks(docs, spark.createDataFrame(items).limit(0)).count() == 0


def test_leak_with_scattered_changes():
    passage = [f"{a}{b}" for a in ("lamp", "road", "tree", "milk", "sand", "corn", "wool", "fish", "rain") for b in "abcdefghij"]
    copy = passage[:45]
    for k in (8, 17, 26, 35):
        copy[k] = passage[80 + k % 7]
    index = leakage.ItemIndex([(1, " ".join(passage)), (2, " ".join(reversed(passage)))])
    assert index.leaked("so it was said that " + " ".join(copy)) == [(1, 41 / 90)]


def test_each_item_is_found_alone():
    items = read("eval_items")
    for i, p in zip(items.item_id, items.passage):
        found = leakage.ItemIndex([(i, p)]).leaked(f"and then we read {p} and that was it")
        assert [x for x, _ in found] == [i] and found[0][1] == 1


def test_disjoint_items():
    a = "copper kettles rust slowly beside open windows during wet autumn evenings near rivers"
    b = "seventeen pilgrims crossed frozen marshland carrying lanterns toward distant mountain chapels before dawn"
    assert leakage.ItemIndex([(1, a), (2, b)]).leaked(f"{b} {a}") == [(2, 1.0), (1, 1.0)]
    assert leakage.ItemIndex([(1, a)]).leaked("СОРРЕR kettlеs rust slowly bеside oреn windоws during wet autumn") == [(1, 10 / 13)]


def test_refilled_questions_are_told_apart():
    item = "the order for 650 bottles of juchedmo was stacked in the hall and 41 jars marked taquo stood by the gate for 9 days"
    other = "the order for 222 bottles of belcuop was stacked in the hall and 77 jars marked rimi stood by the gate for 3 days"
    slip = "the order for 650 bottles of juchedno was stacked in teh hall and 41 jars marked taquo stood by the gate for 9 days"
    index = leakage.ItemIndex([(1, item), (2, other)])
    assert [i for i, _ in index.leaked(item)] == [1] and [i for i, _ in index.leaked(other)] == [2] and [i for i, _ in index.leaked(slip)] == [1]
    assert [i for i, _ in leakage.ItemIndex([(1, item)]).leaked(other)] == []
    assert leakage.slipped("kypel", "kypl") and leakage.slipped("kypel", "kyepl") and not leakage.slipped("kypel", "kylep") and not leakage.slipped("abc", "abd")


def test_item_blocks_change_nothing(spark, monkeypatch):
    docs, items = spark.createDataFrame(read("documents")[["doc_id", "text"]].dropna()), spark.createDataFrame(read("eval_items"))
    found = lambda: sorted(map(tuple, leakage.find_leaks(docs, items).collect()))
    one = found()
    monkeypatch.setattr(leakage, "BLOCK", 40)
    assert found() == one and one


def test_leaks_against_brute_force(spark):
    docs, items = read("documents").dropna(subset=["text"]), read("eval_items")
    got = {(r.doc_id, r.item_id) for r in Q["p6_found"](spark, DATA).collect()}
    sets = {i: leakage.words_of(p) for i, p in zip(items.item_id, items.passage)}
    seven = {}
    for i, ws in sets.items():
        for k in range(len(ws) - 6):
            seven.setdefault(tuple(ws[k : k + 7]), set()).add((i, k))
    for d, t in zip(docs.doc_id, docs.text):
        ws = leakage.words_of(t)
        hit = {}
        for k in range(len(ws) - 6):
            for i, at in seven.get(tuple(ws[k : k + 7]), ()):
                hit.setdefault(i, set()).update(range(at, at + 7))
        for i, places in hit.items():
            if len(places) >= 0.6 * len(sets[i]):
                assert (d, i) in got


# Mixing

def test_mixture(spark):
    rows = [(k, " Blog" if k % 4 == 0 else "news", "one two three four " * (1 + k % 3)) for k in range(400)] + [(900, None, "x y"), (901, "other", "x"), (902, "news", None), (903, "news", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    weights = spark.createDataFrame([("BLOG", 0.5, 3), ("news ", 0.5, 2), ("absent", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    sizes = mixing.sized(docs)
    assert sizes.filter("doc_id in (900, 902, 903)").count() == 0
    rated = mixing.rates(sizes, weights)
    mixed = mixing.mixture(sizes, rated)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mixture(sizes, rated).collect()))
    got = {r.source: r for r in mixing.shares(rated, mixed).collect()}
    assert got["blog"].rate == pytest.approx(3.0) and got["blog"].most_copies == 3 and got["news"].most_copies <= 2 and got["absent"].actual_share == 0
    assert abs(got["blog"].actual_share - 0.5) < 0.03
    assert mixing.shares(mixing.rates(sizes.limit(0), weights), mixed.limit(0)).count() == 3


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None), (3, "")], "i long, t string")
    got = {r.i: r.n_tokens for r in tokens.with_token_counts(df, "t", {"i": F.col("i")}).collect()}
    assert got == {1: len(tokens.encoding().encode_ordinary("héllo wörld")), 2: 0, 3: 0}


# Pieces

def make(n: int, seed: int = 1) -> str:
    rng = random.Random(seed)
    words = ["serum", "ночью", "glow", "façade", "mask", "42", "routine"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("text", [make(9000), "x" * 30_000, "ж" * 9_000, "no breaks " * 4000, "\n\n".join(["short"] * 5000)])
def test_pieces(text):
    cutter = chunking.Cutter()
    pieces = cutter.pieces(text)
    enc = tokens.encoding()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    whole = "".join(text[max(a, last) : b] for (a, b, *_), last in zip(pieces, [0, *(p[1] for p in pieces)]))
    assert whole == text
    for (a, b, n, shared, _), before in zip(pieces[1:], pieces):
        assert a < before[1] <= b and n == len(enc.encode_ordinary(text[a:b])) <= 2000 and 100 <= shared <= 104


def test_edit_stays_local():
    text = make(20_000)
    a, b = ({t[x:y] for x, y, *_ in chunking.Cutter().pieces(t)} for t in (text, text[:3000] + "NEW WORDS " + text[3000:]))
    assert len(a - b) <= 4 and len(a) > 20


def test_short_texts():
    cutter = chunking.Cutter()
    assert cutter.pieces(None) == cutter.pieces("") == cutter.pieces("short") == []
    with pytest.raises(ValueError):
        chunking.Cutter(overlap=500, least=400)


# Subjects

def test_kmeans():
    rng = np.random.default_rng(0)
    centres = np.eye(6, dtype=np.float32)
    x = np.repeat(centres, 40, 0) + rng.normal(0, 0.05, (240, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = subjects.bisecting_kmeans(x, 6)
    assert found.shape == (6, 6) and (np.abs((found @ centres.T).max(0)) > 0.98).all()


def test_window_leaves(monkeypatch):
    told = np.repeat(np.eye(subjects.CLASSES), 50, 0) * 3 + np.random.default_rng(0).random((50 * subjects.CLASSES, subjects.CLASSES)) * 0.2
    told = np.vstack([told, np.random.default_rng(1).random((200, subjects.CLASSES)) * 0.3])
    leaves = subjects.WindowLeaves(told)
    assert [int(leaves.subject[leaves.nearest(np.eye(subjects.CLASSES)[[k]] * 3)[0]]) for k in range(subjects.CLASSES)] == list(range(subjects.CLASSES))
    assert leaves.subject[leaves.nearest(np.zeros((1, subjects.CLASSES)))[0]] == subjects.NONE
    # Without leaves nothing has a subject: rows come from them.
    monkeypatch.setattr(subjects, "WINDOW_LEAVES", 1)
    assert (subjects.WindowLeaves(told).subject == subjects.NONE).all() and len(subjects.WindowLeaves(told[:0]).centres) == 0


def test_decoys_that_stand_alone_learn_nothing():
    """Sentences that stand beside one another and mostly beside nothing told don't take up a subject from a few chances."""
    rng = random.Random(4)
    serum = ["serum calmed skin nicely", "skin adores this toner", "cleanser saved skin quickly"]
    decoy = ["old bridge cracked near our town", "the train line was closed again", "our town hall needs new bricks"]
    filler = "and then we went on to say some more about it all before going home in the rain at night".split()
    texts = []
    for k in range(600):
        pool = serum if k % 5 == 0 else decoy
        a, b = rng.choice(pool), rng.choice(serum if k % 40 == 1 else pool)
        texts.append(f"{a} {' '.join(filler)} {b}")
    examples = [(serum[0], ["skincare"]), (serum[1], ["skincare"]), ("hello everyone", [])]
    df = Counter(w for t in texts for w in set(t.split()))
    terms = subjects.Terms(sorted(df), [], df, len(texts))
    labels = subjects.Labels(terms, examples)
    weight = labels.start()
    for _ in range(subjects.ROUNDS):
        sums, seen = np.zeros((terms.count, subjects.CLASSES + 1)), np.zeros((terms.count, 1))
        subjects._beside(terms, weight, texts, sums, seen)
        weight = labels.after(sums, seen)
    told = lambda w: weight[terms.word[w]].max()
    assert told("cleanser") > 0 and told("bridge") == told("bricks") == told("train") == 0


def test_terms_are_not_capped(spark, monkeypatch):
    monkeypatch.setattr(subjects, "MOST_TERMS", 5, raising=False)
    words = [a + b for a in "bdfghklmnp" for b in ("ora", "eli", "uta")]
    rows = [(k * 4 + n, f"{w} {v}") for k, (w, v) in enumerate(zip(words, words[1:])) for n in range(subjects.LEAST_TEXTS)]
    texts = spark.createDataFrame(rows, "id long, text string")
    examples = spark.createDataFrame([("bora", ["skincare"])], "text string, subjects array<string>")
    assert set(words) <= set(subjects.fit(texts, examples)[0].names)


def test_subjects_come_from_all_rows(spark, monkeypatch):
    """No bound on texts, windows or examples changes a row, nor does the way that texts are spread."""
    posts, known = subjects._inputs(spark, DATA)
    rows = lambda of: sorted((r.id, r.subject) for r in subjects.assign_subjects(of, known).collect())
    whole = rows(posts)
    for bound in ("FIT_TEXTS", "FIT_WINDOWS", "MOST_EXAMPLES"):
        monkeypatch.setattr(subjects, bound, 60, raising=False)
    monkeypatch.setattr(subjects, "BLOCK", 700, raising=False)
    assert whole and rows(posts.repartition(5)) == whole


def test_leaves_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(subjects, "BLOCK", 100, raising=False)
    rng = random.Random(2)
    groups = [[g + v for v in "aeiou"] for g in ("bal", "dor", "kim")]
    texts = [" ".join(rng.choices(groups[k % 3], k=6)) for k in range(300)]
    df = Counter(w for t in texts for w in set(t.split()))
    terms = subjects.Terms(sorted(df), [], df, len(texts))
    ids, pair, owner = terms.place(texts)
    x = terms.vectors(ids, owner, len(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    blocks = subjects.placed(rows, spark.sparkContext.broadcast(terms))
    want = np.array([x[k::3].sum(0) / np.linalg.norm(x[k::3].sum(0)) for k in range(3)])
    for tasks in (0, 64):
        monkeypatch.setattr(subjects, "FEW_TASKS", tasks)
        got = subjects.document_leaves(blocks, 3)
        assert len(got) == 3 and ((got @ want.T).max(0) > 1 - 1e-5).all()
    # Equal texts can't be cut, no text gives no leaf.
    assert len(subjects.document_leaves(blocks.limit(0), 3)) == 0
    same = subjects.placed(rows.withColumn("text", F.lit("bala bale")), spark.sparkContext.broadcast(terms))
    assert len(subjects.document_leaves(same, 3)) == 1


def test_cells_hold_all_windows(spark, monkeypatch):
    told = np.random.default_rng(3).random((500, subjects.CLASSES)) * 4
    told[100:] = told[:100].repeat(4, 0)
    cells = subjects._cells(told)
    assert len(cells) == 100 and cells["n"].sum() == 500
    rows = spark.createDataFrame(pd.concat([cells, subjects._cells(told[:7])]))
    ints = rows.select(*[F.col(c).cast("int").alias(c) for c in subjects.CELL_PLACE], "n", *subjects.CELL_SUMS)
    monkeypatch.setattr(subjects, "WINDOW_LEAVES", 1)
    for most in (100, 9):
        monkeypatch.setattr(subjects, "MOST_CELLS", most)
        leaves = subjects.window_leaves(ints)
        assert leaves.windows == 507 and np.allclose(leaves.mixture[0], np.vstack([told, told[:7]]).mean(0))


def test_subjects_of_examples(spark):
    examples = read("subject_examples")
    posts = spark.createDataFrame(read("processed_posts")[["post_id", "cleaned_text"]]).select(F.col("post_id").alias("id"), F.col("cleaned_text").alias("text"))
    known = spark.createDataFrame(examples[["cleaned_text", "subjects"]].assign(subjects=examples.subjects.map(list))).withColumnRenamed("cleaned_text", "text")
    terms, weight = subjects.fit(posts, known)
    got = subjects.subjects_of(terms, weight, [language.letters(t) for t in examples.cleaned_text])
    named = [{subjects.SUBJECTS[k] for k in np.flatnonzero(r)} for r in got]
    truth = [set(s) for s in examples.subjects]
    hit = sum(len(a & b) for a, b in zip(named, truth))
    assert hit / max(1, sum(map(len, named))) >= 0.9 and hit / sum(map(len, truth)) >= 0.5
    assert subjects.subjects_of(terms, weight, ["", "zzz qqq"]).sum() == 0
    assert subjects.assign_subjects(posts, known.limit(0)).count() == 0 and subjects.assign_subjects(posts.limit(0), known).count() == 0

"""Problem 2: texts that read the same but are made of other characters.

Method: the distinct words of the corpus form tries; a weighted edit automaton walks a trie with one
word and pays nothing for a look-alike letter, for another encoding of an accent and for a character
that nothing is drawn for, and one for any other edit. Words reached at no cost are the same word to a
reader; the spelling that is plain and most frequent becomes canonical. A word that reaches none is
spelled by the table in ``glyphs``.

Only edits at no cost merge words: whatever costs one can be seen, and texts that differ visibly are not the same. Dearer
edits are a parameter of ``Trie.reach`` and decide nothing here.

Scale: most posts hold only words that are canonical as they stand, which linear character tests tell inside the
scan; they take no part in any shuffle of texts. Tries hold only odd words and the plain words with which these share a
form; they are cut into shards by a hash of that form, so that no shard is larger than others. Of each distinct odd text only its odd
words are shuffled. Pairs are expanded last, by buckets of each spelling's rows, so that a text repeated without end spreads
over many tasks; ``lookalike_classes`` gives classes, membership and numbers of links without expanding them.

Defined results: a null text stays null, a blank or invisible text becomes ''; runs of white space
become one blank; posts with equal code points are no pair; an empty table gives empty results; extra
columns are ignored; rows with a null id give no pair.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.glyphs import CYRILLIC, ONLY_CYRILLIC, _piece, skeleton, word_by_table
from tidemark.session import cut

# Fixed values, as classes of Java patterns: letters of canonical texts, those that only Cyrillic has, those of both scripts.
_LATIN, _CYRILLIC, _ONLY = "a-zA-Zß-öø-ÿœ", "а-яё", "бвгджзийклмнптфцчшщъыьэюя"
_SHARED, _SIGNS = "аеорсухёaceopxyisjë", r"!-@\[-`{-~"
STRANGE = rf"[^ !-~{_LATIN}{_CYRILLIC}]|^ | $|  "
EITHER_SCRIPT = rf"(?:^| )[{_SIGNS}]*+[{_SHARED}][{_SHARED}{_SIGNS}]*+(?: |$)"
GAP = r"[\s\x{85}\p{Z}]+"
STRANGE_GAP = r"[\s\x{85}\p{Z}&&[^ ]]"
#: Words in a trie, about; buckets of a spelling's rows.
SHARD_WORDS, BUCKETS = 4_000, 256


class Trie:
    """A vocabulary, its words spelled in decomposed characters on the edges."""

    def __init__(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.words: list[list[tuple[str, int]]] = [[]]

    def add(self, word: str, count: int) -> None:
        node = 0
        for ch in word:
            for part in _decomposed(ch):
                step = self.edges[node].get(part)
                if step is None:
                    step = self.edges[node][part] = len(self.edges)
                    self.edges.append({})
                    self.words.append([])
                node = step
        self.words[node].append((word, count))

    def reach(self, word: str, max_cost: int = 0) -> list[tuple[int, str, int]]:
        """(cost, word, count) of the vocabulary within ``max_cost`` of ``word``.

        Costs: look-alike 0, ignorable 0, any other substitution, insertion or deletion 1.
        """
        alive = self._closed({0: 0}, max_cost)
        for ch in word:
            for part in _piece(ch):
                nxt: dict[int, int] = {}
                for node, cost in alive.items():
                    if cost < max_cost:
                        nxt[node] = min(nxt.get(node, cost + 1), cost + 1)
                    for label, child in self.edges[node].items():
                        price = cost + (_class(label) != part)
                        if price <= max_cost and price < nxt.get(child, max_cost + 1):
                            nxt[child] = price
                alive = self._closed(nxt, max_cost)
                if not alive:
                    return []
        return sorted((cost, w, n) for node, cost in alive.items() for w, n in self.words[node])

    def _closed(self, alive: dict[int, int], max_cost: int) -> dict[int, int]:
        """Adds the states reached by edges taken without input: free for ignorables, else at cost 1."""
        todo = list(alive.items())
        while todo:
            node, cost = todo.pop()
            for label, child in self.edges[node].items():
                price = cost + (_class(label) != "")
                if price <= max_cost and price < alive.get(child, max_cost + 1):
                    alive[child] = price
                    todo.append((child, price))
        return alive


_DECOMPOSED: dict[str, str] = {}


def _decomposed(ch: str) -> str:
    found = _DECOMPOSED.get(ch)
    if found is None:
        found = _DECOMPOSED[ch] = unicodedata.normalize("NFD", ch)
    return found


def _class(label: str) -> str:
    return label if label < "\x80" else _piece(label)


@F.pandas_udf(T.StringType())
def _key(words: pd.Series) -> pd.Series:
    """The form in which words that look the same are equal, accents composed."""
    return words.map(lambda w: unicodedata.normalize("NFC", skeleton(w)))


def _plain_key(word: Column) -> Column:
    """``_key`` of a word without odd characters."""
    both = {c: _piece(c) for c in "аеорсух"} | {"ё": "ë"}
    return F.translate(word, "".join(both), "".join(both.values()))


def _spell(shard: pd.DataFrame) -> pd.DataFrame:
    """One shard: the canonical spelling of each odd word by the shard's trie, else by the table."""
    odd = shard[~shard["plain"]]
    trie = Trie()
    for word, count, skel, plain in zip(shard["word"], shard["n"], map(skeleton, shard["word"]), shard["plain"]):
        if plain or word == word_by_table(skel):
            trie.add(word, int(count))
    out = []
    for word in odd["word"]:
        seen = trie.reach(word)
        best = min(seen, key=lambda x: (not x[1].isascii(), -x[2], x[1]))[1] if seen else word_by_table(skeleton(word))
        out.append((word, best))
    return pd.DataFrame(out, columns=["word", "spelled"])


def spelled_words(words: DataFrame) -> DataFrame:
    """(word, spelled) for every distinct ``word`` that is not canonical as it stands; ``words`` has word, n."""
    # Written first, else the tests would be pushed below the count and run for each occurrence of a word.
    known = cut(words).withColumn("plain", _plain(F.col("word")))
    odd = cut(known.filter("not plain").withColumn("key", _key("word")))
    plain = known.filter("plain").withColumn("key", _plain_key(F.col("word"))).join(odd.select("key").distinct(), "key", "left_semi")
    both = odd.unionByName(plain)
    shards = 1 + odd.count() // SHARD_WORDS
    keyed = both.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(_spell, "word string, spelled string")


def canonical_texts(posts: DataFrame, id_col: str = "post_id", text_col: str = "cleaned_text") -> DataFrame:
    """(id, raw, canonical, stable): every row with a non-null id, its text in the one consistent form."""
    base = posts.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).filter("id is not null")
    stable = _stable(F.coalesce(F.col("raw"), F.lit("")))
    odd = cut(base.filter(~stable).withColumn("mark", F.unhex(F.md5("raw"))))
    whole = F.split(F.regexp_replace("raw", GAP, " "), " ")
    # Strange gaps are rare; elsewhere a blank is the only gap.
    split = F.when(F.col("raw").rlike(STRANGE_GAP), whole).otherwise(F.split("raw", " "))
    words = base.select(F.explode(split).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    texts = odd.select("mark", "raw").distinct()
    held = texts.select("mark", F.explode(F.filter(F.array_distinct(whole), lambda w: (w != "") & ~_plain(w))).alias("word"))
    named = held.join(spelled_words(words), "word").groupBy("mark").agg(F.collect_list(F.struct("word", "spelled")).alias("named"))
    done = texts.join(named, "mark", "left").select("mark", _respelled(whole, "named").alias("canonical"))
    return base.filter(stable).select("id", "raw", F.col("raw").alias("canonical"), F.lit(True).alias("stable")).unionByName(
        odd.join(done, "mark", "left").select("id", "raw", "canonical", F.lit(False).alias("stable"))
    )


def _mixed(word: Column) -> Column:
    return word.rlike(f"[{_CYRILLIC}]") & word.rlike(f"[{_LATIN}]")


def _plain(word: Column) -> Column:
    """A word that is canonical as it stands, whatever stands around it."""
    return ~word.rlike(STRANGE) & ~_mixed(word)


def _stable(text: Column) -> Column:
    """Canonical as it stands. A word that either script could write is settled by the words around it, so a
    text with such a word and with letters of both scripts isn't taken for canonical before that.

    Each test is one pass over the text; only texts with both scripts are split into words."""
    cyrillic, latin, only = (text.rlike(f"[{x}]") for x in (_CYRILLIC, _LATIN, _ONLY))
    some_mixed = F.when(cyrillic & latin, F.exists(F.split(text, " "), _mixed)).otherwise(F.lit(False))
    return ~text.rlike(STRANGE) & ~some_mixed & ~(cyrillic & (latin | ~only) & text.rlike(EITHER_SCRIPT))


@F.pandas_udf(T.StringType())
def _respelled(words: pd.Series, named: pd.Series) -> pd.Series:
    out = []
    for ws, pairs in zip(words, named):
        to = {p["word"]: p["spelled"] for p in pairs} if pairs is not None else {}
        out.append(settle([to.get(w, w) for w in ws if w]))
    return pd.Series(out, dtype=object)


def settle(words: list[str]) -> str:
    """Joins spelled words; one that either script could write takes the script of the last other word, at the
    start that of the next, else Latin. This depends on nothing but what a reader sees."""
    forms = [skeleton(w) for w in words]
    script = next((x for x in map(_script, forms) if x), "l")
    out = []
    for word, form in zip(words, forms):
        own = _script(form)
        script = own or script
        if own is None:
            form = "".join(CYRILLIC.get(ch, ch) for ch in form) if script == "c" else form
            word = unicodedata.normalize("NFC", form)
        out.append(word)
    return " ".join(w for w in out if w)


def _script(form: str) -> str | None:
    """'c' or 'l' by the letters of a skeleton word; '' for a word without letters, None if both could write it."""
    letters = [ch for ch in form if ch.isalpha()]
    if not letters:
        return ""
    if ONLY_CYRILLIC.search(form):
        return "c"
    return None if all(ch in CYRILLIC for ch in letters) else "l"


def _near(texts: DataFrame) -> DataFrame:
    """(key, spelling, id) of the rows whose class has an odd member.

    Stable texts are distinct spellings of distinct canonical texts, so another class has one spelling. Bytes, not
    letters, are compared: no collation takes part. The keys are written once and read several times."""
    keyed = cut(texts.filter("canonical <> ''").select(
        "id", "stable", F.unhex(F.md5("canonical")).alias("key"), F.unhex(F.md5("raw")).alias("spelling")
    ))
    odd_keys = keyed.filter("not stable").select("key").distinct()
    return keyed.join(odd_keys, "key", "left_semi").select("key", "spelling", "id").distinct()


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(id, class_id, spelling, links): the members of each class of two spellings or more, ``links`` being the
    number of rows that look the same but are spelled otherwise. Nothing is expanded into pairs."""
    near = cut(_near(texts))
    sizes = near.groupBy("key", "spelling").agg(F.count("*").alias("own"))
    totals = sizes.groupBy("key").agg(F.sum("own").alias("rows"), F.count("*").alias("spellings")).filter("spellings > 1")
    links = sizes.join(totals, "key").select("key", "spelling", (F.col("rows") - F.col("own")).alias("links"))
    return near.join(links, ["key", "spelling"]).select("id", F.lower(F.hex("key")).alias("class_id"), F.lower(F.hex("spelling")).alias("spelling"), "links")


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of ``canonical_texts`` with equal canonical and unequal raw text.

    Joined between buckets of the spellings of a canonical text first and expanded to rows last. Each pair of buckets
    stands for a pair of rows at least, so nothing on the way is larger than the result, and a text repeated without
    end meets no copy of itself."""
    near = cut(_near(texts).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))))
    forms = near.select("key", "spelling", "bucket").distinct()
    side = lambda df, s, i: df.select("key", F.col("spelling").alias(s), F.col("bucket").alias(f"{s}_bucket"), *i)
    both = side(forms, "a", []).join(side(forms, "b", []), "key").filter("a < b")
    pairs = both.join(side(near, "a", [F.col("id").alias("x")]), ["key", "a", "a_bucket"])
    pairs = pairs.join(side(near, "b", [F.col("id").alias("y")]), ["key", "b", "b_bucket"])
    return pairs.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spark.read.parquet(f"{sf_dir}/processed_posts.parquet")
    pairs = lookalike_pairs(canonical_texts(posts))
    return pairs.select(F.col("id_a").alias("post_id_a"), F.col("id_b").alias("post_id_b"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its text in the one form."""
    posts = spark.read.parquet(f"{sf_dir}/processed_posts.parquet")
    return canonical_texts(posts).select(F.col("id").alias("post_id"), F.col("canonical").alias("canonical_text"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that look like another post but are spelled otherwise, their class and their number of links."""
    posts = spark.read.parquet(f"{sf_dir}/processed_posts.parquet")
    return lookalike_classes(canonical_texts(posts)).select(F.col("id").alias("post_id"), "class_id", "spelling", "links")

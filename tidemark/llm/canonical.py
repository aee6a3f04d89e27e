"""Problem 5: values as people typed them, mapped to a reference list.

Method: the distinct values are normalised; a character n-gram inverted index of the reference list gives
their candidates; candidates are scored by weighted cosine; the best is accepted above a threshold and a
margin to the next entry. An exact check follows: the value must hold the accepted entry's rare part, give or take a
slip; it can only refuse, never choose another entry.

Forms of an entry: its words in each rotation (people write the type first), with and without the words
that many brands share ("house words"). Two spellings of a value are tried, as typed and by sound, and the
better counts. An n-gram weighs by how few reference entries hold it, so that the brand decides and the
product type tells the brand's entries apart; n-grams no entry holds weigh most and count against a match. N-grams
of both ends are marked.

Scale: work is per distinct value. The index lives in broadcast blocks of at most ``BLOCK`` entries; a longer
reference list takes several blocks whose best candidates are merged, so that no broadcast grows with the data. What
is counted over the list (weights, house words, rare parts) is counted over all blocks.

Defined results: a null or blank value has no row; a value of which nothing is left (signs, filler) is
unmatched; equal scores of different entries leave too small a margin and are unmatched, except that an
entry repeated in the list takes its lowest id; an empty reference list leaves all unmatched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference entries in one broadcast index.
BLOCK = 20_000
TASKS_PER_CORE = 4
#: Least cosine of an accepted entry and least distance of it to that of the next entry.
ACCEPT, MARGIN = 0.3, 0.01
#: A word is a house word if at least so many brands hold it.
HOUSE_BRANDS = 3
# Words people put around a name; sizes ("50ml") are left out as well.
FILLER = frozenset("new mini the my by tm of a an".split())
SIZE = re.compile(r"\d*(?:ml|cl|oz|kg)|\d+[gl]")
# Spelling by sound, applied in this order.
SOUND = (("ph", "f"), ("kh", "k"), ("ch", "k"), ("ck", "k"), ("x", "ks"), ("c", "k"), ("q", "k"), ("y", "i"), ("z", "s"), ("w", "v"))


def flat(text: str) -> list[str]:
    """Lower-case words without accents, signs and filler; words run together in mixed case come apart."""
    text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    if not text.isupper():
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"(?<=[^\W\d_])(?=\d+(?:ml|cl|oz|kg|g|l)\b)", " ", text.lower())
    return [w for w in re.findall(r"[^\W_]+", text) if w not in FILLER and not SIZE.fullmatch(w)]


def by_sound(word: str) -> str:
    for a, b in SOUND:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def grams(word: str) -> list[str]:
    """Pairs and triples of letters of a whole value, its ends marked."""
    word = f"^{word}$" if word else ""
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]


def edits_within(name: str, text: str, most: int) -> int:
    """Edits (also swaps of neighbours) that turn ``name`` into some stretch of ``text``; most + 1 if more."""
    before: list[int] = []
    row = [0] * (len(text) + 1)
    for i, a in enumerate(name, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b))
            if i > 1 and j > 1 and a == text[j - 2] and name[i - 2] == b:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return min(row)


def names(core: str, words: list[str], known: set[str]) -> bool:
    """Whether the words hold ``core``, give or take a slip: as a word, or run together with known other words."""
    most = 0 if len(core) < 5 else 1 if len(core) < 8 else 2
    if any(edits_within(core, w, most) + max(0, len(w) - len(core) - 1) <= most for w in words):
        return True
    squeezed = "".join(words)
    cost, end = _last(core, squeezed)
    if cost > most:
        return False
    back, length = _last(core[::-1], squeezed[:end][::-1])
    begin, bounds = end - length, {0}
    for w in words:
        bounds.add(max(bounds) + len(w))
    left = squeezed[max(b for b in bounds if b <= begin) : begin]
    right = squeezed[end : min(b for b in bounds if b >= end)]
    return all(len(x) < 2 or sum(g in known for g in _pairs(x)) >= 0.7 * (len(x) - 1) for x in (left, right))


def _pairs(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def _last(name: str, text: str) -> tuple[int, int]:
    """Least edits of ``name`` to a stretch of ``text``, and where the last such stretch ends."""
    before: list[int] = []
    row = [0] * (len(text) + 1)
    for i, a in enumerate(name, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b))
            if i > 1 and j > 1 and a == text[j - 2] and name[i - 2] == b:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return min(row), len(row) - 1 - row[::-1].index(min(row))


class Listed:
    """What an index needs to know of the whole reference list, however many blocks it takes.

    ``entries`` is called for each of two passes. Kept are the words of the list and its n-grams, not the entries."""

    def __init__(self, entries: Callable[[], Iterable[tuple[int, str, str | None]]]) -> None:
        self.df: Counter[str] = Counter()
        brands: list[list[str]] = []
        # The rare part of an entry: words of its brand, those that products share with it where there are such.
        sold: set[str] = set()
        for _, name, kind in entries():
            ws = flat(name)
            self.df.update(set(ws))
            brands.append(ws) if kind == "brand" else sold.update(ws)
        of_brands = Counter(w for ws in brands for w in set(ws))
        house = {w for w, n in of_brands.items() if n >= HOUSE_BRANDS}
        cores = set()
        for ws in brands:
            own = [w for w in ws if w not in house]
            cores.add(tuple([w for w in own if w in sold] or own))
        cores -= {()}
        self.by_word = {c[0]: c for c in sorted(cores)}
        plain = set(self.df) - {w for c in cores for w in c} | FILLER
        self.known = {g for w in plain for g in (*_pairs(w), *_pairs(by_sound(w)))}
        held: Counter[str] = Counter()
        n = 0
        for _, name, kind in entries():
            _, forms = self.forms(flat(name), kind)
            held.update({g for form in forms for g in grams(form)})
            n += bool(forms)
        self.top = 1 + math.log(n or 1)
        self.weight = {g: 1 + math.log(n / who) for g, who in held.items()}

    def forms(self, ws: list[str], kind: str | None) -> tuple[str, list[str]]:
        """The rare part of an entry of these words and its forms, as typed and by sound."""
        if not ws:
            return "", []
        core = next((self.by_word[w] for w in ws if w in self.by_word and all(x in ws for x in self.by_word[w])), None)
        core = core or (min(ws, key=lambda w: (self.df[w], -len(w))),)
        turned = {tuple(ws[k:] + ws[:k]) for k in range(len(ws))}
        if kind == "brand":
            turned.add(core)
        return "".join(core), [x for form in sorted(turned) for x in sorted({"".join(form), by_sound("".join(form))})]


class Index:
    """The inverted index of one block of the reference list."""

    def __init__(self, entries: list[tuple[int, str, str | None]], listed: Listed | None = None) -> None:
        listed = listed or Listed(lambda: entries)
        self.top, self.weight, self.known = listed.top, listed.weight, listed.known
        self.ids: list[int] = []
        self.cores: list[str] = []
        self.forms: list[str] = []
        for i, name, kind in sorted(entries, key=lambda e: (e[0], e[1], e[2] or "")):
            core, forms = listed.forms(flat(name), kind)
            self.ids += [i] * len(forms)
            self.cores += [core] * len(forms)
            self.forms += forms
        at: dict[str, list[tuple[int, float]]] = {}
        for k, form in enumerate(self.forms):
            vector = {g: self.weight[g] * c for g, c in Counter(grams(form)).items()}
            norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
            for g, x in vector.items():
                at.setdefault(g, []).append((k, x / norm))
        self.postings = {g: (np.array([k for k, _ in x], np.int32), np.array([v for _, v in x], np.float32)) for g, x in at.items()}

    def scores(self, squeezed: str) -> np.ndarray:
        got = np.zeros(len(self.ids), np.float32)
        total = 0.0
        for g, c in Counter(grams(squeezed)).items():
            x = self.weight.get(g, self.top) * c
            total += x * x
            if g in self.postings:
                rows, values = self.postings[g]
                got[rows] += x * values
        return got / math.sqrt(total) if total else got

    def best(self, value: str) -> list[tuple[float, int, bool]]:
        """(cosine, id, whether the value holds the entry's rare part) of the two best entries of this block."""
        words = flat(value)
        squeezed = "".join(words)
        if not squeezed or not self.ids:
            return []
        got = np.maximum(self.scores(squeezed), self.scores(by_sound(squeezed)))
        found: dict[int, tuple[float, int]] = {}
        for k in np.flatnonzero(got >= ACCEPT - MARGIN).tolist():
            i, score = self.ids[k], float(got[k])
            if i not in found or score > found[i][0]:
                found[i] = score, k
        first = sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:2]
        return [(score, i, self._named(self.cores[k], words)) for i, (score, k) in first]

    def _named(self, core: str, words: list[str]) -> bool:
        return names(core, words, self.known) or names(by_sound(core), [by_sound(w) for w in words], self.known)


def map_values(values: DataFrame, reference: DataFrame, value_col: str, id_col: str, name_col: str, kind_col: str) -> DataFrame:
    """(value, canon_id, score) for each distinct non-blank value; canon_id is -1 where none was meant."""
    spark = values.sparkSession
    distinct = values.select(F.col(value_col).alias("value")).filter(F.trim("value") != "").distinct()
    # Values are short and each takes milliseconds: partitions sized by bytes would leave most cores idle.
    distinct = distinct.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "value")
    listed = reference.select(F.col(id_col).cast("long").alias("i"), F.col(name_col).alias("n"), F.col(kind_col).alias("k"))
    # An entry repeated in the list counts once, by its lowest id.
    listed = listed.filter("i is not null and n is not null").groupBy("n", "k").agg(F.min("i").alias("i"))
    blocks = -(-listed.count() // BLOCK)
    whole = Listed(lambda: ((r.i, r.n, r.k) for r in listed.toLocalIterator())) if blocks > 1 else None
    found = None
    for b in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r.i, r.n, r.k) for r in part.collect()], whole))

        def look(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(v, i, s, n) for v in pdf["value"] for s, i, n in index.value.best(v)]
                yield pd.DataFrame(rows, columns=["value", "canon_id", "score", "named"])

        each = distinct.mapInPandas(look, "value string, canon_id long, score double, named boolean")
        found = each if found is None else found.unionByName(each)
    if found is None:
        return distinct.select("value", F.lit(-1).cast("long").alias("canon_id"), F.lit(0.0).alias("score"))
    ranked = found.groupBy("value").agg(
        F.max(F.struct("score", (-F.col("canon_id")).alias("minus"), "named")).alias("first"), F.sort_array(F.collect_list("score"), False).alias("all")
    )
    clear = (F.size("all") < 2) | (F.element_at("all", 1) - F.try_element_at("all", F.lit(2)) >= MARGIN)
    taken = ranked.select("value", F.when(clear & (F.col("first.score") >= ACCEPT) & F.col("first.named"), -F.col("first.minus")).otherwise(-1).alias("canon_id"), F.col("first.score").alias("score"))
    return distinct.join(taken, "value", "left").select("value", F.coalesce("canon_id", F.lit(-1)).cast("long").alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.read.parquet(f"{sf_dir}/term_counts.parquet").select("term_id", "term", "feature_type", "loaded_at")
    typed = terms.filter((F.col("feature_type") == "product") & (F.trim("term") != "") & F.col("term_id").isNotNull())
    return typed.groupBy("term_id").agg(F.max_by("term", F.struct("loaded_at", "term")).alias("term"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    reference = spark.read.parquet(f"{sf_dir}/canonical_terms.parquet")
    mapped = map_values(typed, reference, "term", "canon_id", "canonical", "kind")
    return typed.join(mapped, typed["term"] == mapped["value"]).select("term_id", "canon_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unmatched values with the number of records that hold them."""
    typed = _typed(spark, sf_dir)
    reference = spark.read.parquet(f"{sf_dir}/canonical_terms.parquet")
    mapped = map_values(typed, reference, "term", "canon_id", "canonical", "kind").filter("canon_id = -1")
    return typed.join(mapped, typed["term"] == mapped["value"]).groupBy(F.col("value").alias("term")).agg(F.count("*").alias("records"))

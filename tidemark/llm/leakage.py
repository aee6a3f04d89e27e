"""Problem 6: passages of test items that occur, whole or in part, in corpus documents.

Method: template canonicalisation. Numbers, units and names become typed placeholders; windows of template words
of the documents are hash-joined with those of the items; matching windows on one diagonal are joined to
stretches. Slot consistency then tells a copy from a question re-parameterised: where the numbers and names of a
stretch differ from the passage's, the words are of another text. An item leaked into a document if the words of
its consistent stretches make up at least ``SHARE`` of the passage.

A name is a word that fewer than two different passages of the whole list hold; the list is counted once, before it is
cut into blocks, so results don't depend on ``BLOCK``. Windows of a passage's very words are indexed beside the template
windows, so a verbatim passage is found whatever the other items hold. A stretch counts if its slots agree (no more
than one in three differs, and of the numbers alone no more than half; a name with a slip of the pen is no other name)
and it has an agreeing slot, or if it has no differing slot and at least ``PLAIN`` equal words.

Scale: the documents pass once, without a shuffle; the item index is a broadcast of blocks of at most ``BLOCK``
items, so it doesn't grow with the corpus. Beside it go the words that two passages hold, which grow with the list's
vocabulary. A document's windows never leave its task.

Defined results: case, accents, punctuation, spacing, line breaks and look-alike characters don't count; null or
blank passages and texts match nothing; passages of fewer than ``WINDOW`` words match nothing; an item repeated
under other ids is reported for each id; a document repeated is reported for each of its rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.glyphs import skeleton

BLOCK = 20_000
WINDOW, SHARE, PLAIN = 4, 0.4, 9
#: Words between windows of a run; words put in or taken out between runs; words from run to run.
GAP, DRIFT, REACH = 3, 4, 12
NUMBER, NAME, UNIT = 1, 2, 3
#: Salt by which verbatim windows differ from template windows.
VERBATIM = 0x51ED
# Units of measure and of time in the languages of the items.
UNITS = frozenset(
    "grams gram kg kilograms litres liters ml millilitres metres meters minutes hours days weeks months years percent "
    "gramos gramo minutos horas dias semanas meses grammes gramme heures jours semaines mois ans gramm minuten stunden tage "
    "wochen monate jahre grammi minuti ore giorni settimane gramas".split()
)
_WORDS = re.compile(r"[^\W_]+")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code)
        flat = " " if ch.isspace() else skeleton(ch.lower()).lower()
        found = self[code] = "".join(x for x in flat if not "\u0300" <= x <= "\u036f")
        return found


_FOLD = _Fold()


def words_of(text: str | None) -> list[str]:
    """Lower-case words without accents, each look-alike letter in its one form."""
    if not text:
        return []
    return _WORDS.findall(text.lower() if text.isascii() else text.translate(_FOLD))


def template_words(passages: Iterable[str]) -> list[str]:
    """The words, numbers and units aside, that at least two different passages hold."""
    seen: set[int] = set()
    held: Counter[str] = Counter()
    for passage in passages:
        words = words_of(passage)
        mark = xxhash.xxh3_64_intdigest(" ".join(words))
        if mark not in seen:
            seen.add(mark)
            held.update(set(words))
    return sorted(w for w, n in held.items() if n >= 2 and not w.isdigit() and w not in UNITS)


class ItemIndex:
    """Template windows and verbatim windows of a block of items; ``common`` are the template words of the whole list."""

    def __init__(self, items: list[tuple[int, str]], common: list[str] | None = None) -> None:
        self.words = {i: words_of(p) for i, p in items}
        common = template_words(p for _, p in items) if common is None else common
        self.code = {w: k + 4 for k, w in enumerate(common)} | {u: UNIT for u in UNITS}
        # A word's id tells its very form, ``self.types`` what the template has in its place.
        every = sorted({w for ws in self.words.values() for w in ws} | set(self.code))
        self.ids = {w: k + 3 for k, w in enumerate(every)}
        self.types = np.array([NAME, NUMBER, 0, *(self.code.get(w) or (NUMBER if w.isdigit() else NAME) for w in every)], np.uint64)
        at: dict[int, list[tuple[int, int]]] = {}
        for i, ws in self.words.items():
            ids = self.placed(ws)
            types = self.types[ids]
            telling = np.convolve(types > UNIT, np.ones(WINDOW, int), "valid") >= 2 if len(types) >= WINDOW else ()
            for k in np.flatnonzero(telling).tolist():
                at.setdefault(int(self.hashes(types[k : k + WINDOW])[0]), []).append((i, k))
            for k, h in enumerate(self.hashes(ids.astype(np.uint64), VERBATIM).tolist()):
                at.setdefault(h, []).append((i, k))
        self.keys = np.array(sorted(at), np.uint64)
        self.posts = [at[k] for k in self.keys.tolist()]

    def placed(self, words: list[str]) -> np.ndarray:
        """The id of each word: 0 for one of no item, 1 for such a number."""
        get = self.ids.get
        return np.array([get(w) or int(w.isdigit()) for w in words], np.int64)

    @staticmethod
    def hashes(codes: np.ndarray, salt: int = 0x9E37) -> np.ndarray:
        n = len(codes) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = (h ^ (codes[k : k + n] + np.uint64(salt))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    def leaked(self, text: str | None) -> list[tuple[int, float]]:
        """(item, share of its passage) for the items that leaked into the text."""
        words = words_of(text)
        if len(words) < WINDOW or not len(self.keys):
            return []
        ids = self.placed(words)
        seeds: dict[int, dict[int, list[int]]] = {}
        for found in (self.hashes(self.types[ids]), self.hashes(ids.astype(np.uint64), VERBATIM)):
            slot = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            for at in np.flatnonzero(self.keys[slot] == found).tolist():
                for item, k in self.posts[slot[at]]:
                    seeds.setdefault(item, {}).setdefault(at - k, []).append(k)
        out = []
        for item, diagonals in seeds.items():
            passage = self.words[item]
            runs = [run for shift, ks in diagonals.items() for run in self._runs(passage, words, shift, sorted(set(ks)))]
            share = len(self._consistent(passage, words, runs)) / len(passage)
            if share >= SHARE:
                out.append((item, share))
        return out

    @staticmethod
    def _runs(passage: list[str], words: list[str], shift: int, ks: list[int]) -> list[tuple[int, int, int]]:
        """(place in the text, first and end position in the passage) of the stretches on one diagonal."""
        runs: list[list[int]] = []
        for k in ks:
            if runs and k <= runs[-1][1] + GAP:
                runs[-1][1] = max(runs[-1][1], k + WINDOW)
            else:
                runs.append([k, k + WINDOW])
        out = []
        for a, b in runs:
            while a > 0 and a + shift > 0 and passage[a - 1] == words[a - 1 + shift]:
                a -= 1
            while b < len(passage) and b + shift < len(words) and passage[b] == words[b + shift]:
                b += 1
            # A slot at an end may hold anything: a stretch begins and ends with a word of the passage.
            while a < b and passage[a] != words[a + shift]:
                a += 1
            while a < b and passage[b - 1] != words[b - 1 + shift]:
                b -= 1
            if a < b:
                out.append((a + shift, a, b))
        return out

    def _slot(self, word: str) -> int:
        """NUMBER or NAME, 0 for a word of the template. A slot that holds a template word was damaged, not refilled."""
        return NUMBER if word.isdigit() else 0 if word in self.code else NAME

    def _consistent(self, passage: list[str], words: list[str], runs: list[tuple[int, int, int]]) -> set[int]:
        """The passage's positions that runs carry. Runs that follow one another, a few words having been put in or
        taken out between them, stand or fall together by their slots."""
        chains: list[list[tuple[int, int, int]]] = []
        for run in sorted(runs):
            at, a, _ = run
            for chain in chains:
                last_at, last_a, last_b = chain[-1]
                last_end = last_at + last_b - last_a
                if abs((at - a) - (last_at - last_a)) <= DRIFT and -WINDOW < at - last_end <= REACH and -WINDOW < a - last_b <= REACH:
                    chain.append(run)
                    break
            else:
                chains.append([run])
        kept: set[int] = set()
        for chain in chains:
            equal, slots = set(), {NUMBER: {}, NAME: {}}
            # Slots between two stretches of one diagonal are judged too.
            between = [(x + b - a, b, c) for (x, a, b), (y, c, _) in zip(chain, chain[1:]) if x - a == y - c]
            for at, a, b in [*chain, *between]:
                for k in range(a, b):
                    mine, theirs = passage[k], words[k + at - a]
                    kind = self._slot(mine)
                    if mine == theirs:
                        equal.add(k)
                    if kind and (mine == theirs or self._slot(theirs) == kind and not (kind == NAME and slipped(mine, theirs))):
                        slots[kind][k] = slots[kind].get(k, False) or mine == theirs
            numbers, names = slots[NUMBER].values(), slots[NAME].values()
            same, other = sum(numbers) + sum(names), len(numbers) + len(names) - sum(numbers) - sum(names)
            if same and other <= same / 2 and 2 * sum(numbers) >= len(numbers) or not other and len(equal) >= PLAIN:
                kept |= equal
        return kept


def slipped(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours that changed places, make one name of the other."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[k:], b[k:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or x[:2] == y[1::-1] and x[2:] == y[2:]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               passage_col: str = "passage") -> DataFrame:
    """(doc_id, item_id, share) for every document and every item that leaked into it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    listed = items.select(F.col(item_id).alias("i"), F.col(passage_col).alias("p")).filter("i is not null and trim(p) <> ''").distinct()
    kinds = texts.schema["doc_id"].dataType.simpleString(), listed.schema["i"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, share double"
    blocks = -(-listed.count() // BLOCK)
    common = template_words(r.p for r in listed.select("p").distinct().toLocalIterator())
    found = None
    for b in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "p").collect()
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.p) for r in part], common))

        def look(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, i, s) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, s in index.value.leaked(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

        each = texts.mapInPandas(look, schema)
        found = each if found is None else found.unionByName(each)
    return found if found is not None else spark.createDataFrame([], schema)


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and leaked items with the share of the passage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()

"""Text expressions. Each takes and gives a Column and stays inside the JVM.

A null text counts as '' wherever a result is built from it: it cleans to '', has no tags and no tokens, is not relevant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L


def any_of(words: Iterable[str]) -> str:
    """One pattern that finds any of the literals, a single pass instead of one for each word.

    Words that hold another of the words are left out, and common beginnings are shared, so that at most places of a
    text one look at a character decides."""
    words = sorted(set(words))
    words = [w for w in words if not any(x != w and x in w for x in words)]

    def tree(tails: list[str]) -> str:
        if "" in tails or not tails:
            return ""
        heads = sorted({t[0] for t in tails})
        branches = [_literal(h) + tree([t[1:] for t in tails if t[0] == h]) for h in heads]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return f"(?=[{''.join(sorted({_literal(w[0]) for w in words}))}])" + tree(words) if words else "(?!)"


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch == " " else f"\\{ch}"


def relevant(text: Column, words: Iterable[str] | None = None) -> Column:
    """The lower-cased raw text contains one of the words, anywhere."""
    words = [w for ws in L.CATEGORY_KEYWORDS.values() for w in ws] if words is None else list(words)
    return F.coalesce(F.lower(text).rlike(any_of(words)), F.lit(False))


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), L.EMOJI, " ")


def clean(text: Column) -> Column:
    """Lower case without emoji, addresses, mentions and signs; '#' and '_' stay; single blanks.

    Three passes: addresses, all else that becomes a blank, runs of blanks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (L.ADDRESS, L.NOISE, "  +"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def hashtags(text: Column) -> Column:
    """Tags of the raw text without '#', lower case, in order, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(L.HASHTAG), F.lit(1))
    return F.transform(found, F.lower)


def tokens(cleaned: Column) -> Column:
    """Words of a cleaned text that are longer than two characters and no stop words."""
    stop = F.array(*[F.lit(w) for w in L.STOP_WORDS])
    return F.filter(F.split(cleaned, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keyword_hits(text: Column, words: Iterable[str] = L.VOCABULARY_KEYWORDS) -> Column:
    """The words that the lower-cased text contains, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def term_clean(text: Column) -> Column:
    """Lower case; addresses, mentions and tags taken out without a blank; signs to blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), L.TERM_NOISE, ""), L.TERM_SPECIAL, " ")


def term_name(term: Column) -> Column:
    """The form in which terms are looked up."""
    return F.trim(F.translate(F.regexp_replace(F.lower(term), "#", ""), "_", " "))


def is_word_term(term: Column) -> Column:
    """Letters and blanks only, leading '#' aside and '_' read as a blank."""
    bare = F.translate(F.regexp_replace(term, "^#+", ""), "_", " ")
    return F.coalesce(bare.rlike(rf"^[{L.SPACE}]*\p{{L}}+([{L.SPACE}]+\p{{L}}+)*[{L.SPACE}]*$"), F.lit(False))

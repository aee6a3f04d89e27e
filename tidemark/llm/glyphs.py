"""One written form for characters that look alike.

``skeleton`` is the comparison form (every look-alike class has one member), ``by_table`` the
readable form built from it. Both are pure functions of one string.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that a reader takes for a Latin letter, small ones first.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "ԁ": "d", "е": "e", "ҽ": "e", "ɡ": "g", "һ": "h", "հ": "h", "і": "i", "ι": "i",
    "ı": "i", "ј": "j", "ϳ": "j", "ӏ": "l", "ո": "n", "о": "o", "ο": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q",
    "ѕ": "s", "с": "c", "ϲ": "c", "ս": "u", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "γ": "y",
    "ʏ": "y", "ᴢ": "z",
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Ϲ": "C", "Е": "E", "Ε": "E", "Н": "H", "Η": "H", "І": "I", "Ι": "I",
    "Ј": "J", "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Ѕ": "S", "Т": "T",
    "Τ": "T", "Х": "X", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
# The Cyrillic letter for each Latin one, to write a Cyrillic word again.
CYRILLIC = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "i": "і", "s": "ѕ", "j": "ј",
            "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т",
            "X": "Х"}

SPACES = re.compile(r"[\s   -     　]+")
ONLY_CYRILLIC = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯ]")


def ignorable(ch: str) -> bool:
    """Nothing is drawn for it: format characters, variation selectors, joiners, fillers."""
    return unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace() or ch in "͏᠋᠌᠍᠎ᅟᅠㅤﾠ឴឵" or "︀" <= ch <= "️"


def pieces(ch: str) -> str:
    """The base characters and marks that ``ch`` is drawn from, each as its class member; '' if nothing is drawn."""
    if ignorable(ch):
        return ""
    flat = unicodedata.normalize("NFKD", ch)
    return "".join(LOOKALIKES.get(x, x) for x in flat if not ignorable(x))


_PIECES: dict[str, str] = {}


def _piece(ch: str) -> str:
    found = _PIECES.get(ch)
    if found is None:
        found = _PIECES[ch] = pieces(ch)
    return found


def skeleton(text: str) -> str:
    """The form in which texts that look the same are equal; runs of white space become one blank."""
    if text.isascii():
        return " ".join(text.split())
    flat = "".join([ch if ch < "\x80" else " " if ch.isspace() else _piece(ch) for ch in text])
    return " ".join(unicodedata.normalize("NFD", flat).split())


def word_by_table(skel: str) -> str:
    """A readable spelling of one skeleton word: Cyrillic again if a letter of it can only be Cyrillic."""
    if skel.isascii():
        return skel
    if ONLY_CYRILLIC.search(skel):
        skel = "".join(CYRILLIC.get(ch, ch) for ch in skel)
    return unicodedata.normalize("NFC", skel)


def by_table(text: str) -> str:
    """The whole text spelled by the table, word by word."""
    if text.isascii():
        return " ".join(text.split())
    return " ".join(word_by_table(w) for w in skeleton(text).split(" "))

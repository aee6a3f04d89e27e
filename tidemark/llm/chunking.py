"""Problem 8: texts over a size limit cut into overlapping pieces.

Method: content-defined chunking. A rolling hash of the last ``WINDOW`` tokens marks landmarks; the first
landmark at least ``least`` tokens after the last cut snaps to the nearest natural boundary that keeps the
piece within its limits (paragraph, then line, then sentence, then word gap). Cuts follow the text around
them, so an edit moves the cuts near it and later ones fall where they fell before. Each piece begins ``overlap``
tokens before the end of the last one.

Scale: one pass without a shuffle; a text that has no more bytes than the limit has tokens is passed over
untokenised, as no token is shorter than a byte. Every longer text is tokenised whole.

Defined results: texts within the limit, null and empty texts give no row; each piece, tokenised on its own,
is within the limit; pieces cover the text without a gap; where no boundary is near, a cut falls between two
tokens, never inside a character (the overlap is then a token or two longer); a repeated document is cut again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKENIZER, encoding

LIMIT, OVERLAP, LEAST = 2000, 100, 1000
#: Tokens in the rolling hash; one position in ``EVERY`` is a landmark.
WINDOW, EVERY = 12, 128
#: Ends of natural stretches, strongest first; a cut falls behind the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*|\n(?=#+ )")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?=\s|$)")),
    ("word", re.compile(r"(?<=\S)(?=\s)")),
)


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Positions i such that the hash of tokens i - WINDOW .. i - 1 falls on one value in EVERY."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x100000001B3) + mixed[k : k + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    return np.flatnonzero(rolled % np.uint64(EVERY) == 0) + WINDOW


class Cutter:
    def __init__(self, path: str = TOKENIZER, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> None:
        if not 0 <= overlap < least < limit:
            raise ValueError("0 <= overlap < least < limit is needed")
        self.enc, self.limit, self.overlap, self.least = encoding(path), limit, overlap, least

    def pieces(self, text: str | None) -> list[tuple[int, int, int, int, str]]:
        """(start, end, tokens, overlap, boundary) of each piece, in characters; [] if the text is within the limit."""
        if not text or len(text.encode()) <= self.limit:
            return []
        ids = np.array(self.enc.encode_ordinary(text), np.int64)
        if len(ids) <= self.limit:
            return []
        sizes = np.array([len(self.enc.decode_single_token_bytes(i)) for i in ids.tolist()], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(text.encode(), np.uint8)
        first = np.append((raw & 0xC0) != 0x80, True)  # bytes at which a character begins, and the end
        chars = np.cumsum(first) - 1
        whole = first[starts]  # tokens that begin a character
        at = {}
        byte_of = np.flatnonzero(first)
        for name, pattern in BOUNDARIES:
            ends = byte_of[np.array([m.end() for m in pattern.finditer(text)], np.int64)] if len(text) else []
            found = np.searchsorted(starts, ends)
            at[name] = np.unique(found[starts[np.minimum(found, len(ids))] == ends])
        marks = landmarks(ids)
        out, begin, last, shared = [], 0, 0, 0
        while True:
            most = self.limit
            while True:
                if len(ids) - begin <= most:
                    end, kind = len(ids), "end"
                else:
                    end, kind = self._cut(last, begin, most, marks, at, whole)
                piece = text[chars[starts[begin]] : chars[starts[end]]]
                n = len(self.enc.encode_ordinary(piece))
                if n <= self.limit:
                    break
                most -= n - self.limit  # tokens at the edges fall apart when the piece stands alone
            out.append((int(chars[starts[begin]]), int(chars[starts[end]]), n, shared, kind))
            if end == len(ids):
                return out
            last = end
            begin = max(end - self.overlap, begin + 1)
            while begin > 0 and not whole[begin]:
                begin -= 1
            shared = end - begin

    def _cut(self, last: int, begin: int, most: int, marks: np.ndarray, at: dict[str, np.ndarray], whole: np.ndarray) -> tuple[int, str]:
        low, high = min(last + self.least, begin + most - 1), begin + most
        k = np.searchsorted(marks, low)
        wish = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        for name, where in at.items():
            i, j = np.searchsorted(where, low), np.searchsorted(where, high, "right")
            if i < j:
                near = where[i:j]
                return int(near[np.argmin(np.abs(near - wish))]), name
        end = wish
        while end > begin + 1 and not whole[end]:
            end -= 1
        return end, "none"


def split_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER,
               limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, n_tokens, overlap_tokens, boundary, piece) of each text over the limit."""
    long = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(path, limit, overlap, least)
        for pdf in batches:
            rows = [
                (i, k, a, b, n, shared, kind, text[a:b])
                for i, text in zip(pdf["doc_id"], pdf["text"])
                for k, (a, b, n, shared, kind) in enumerate(cutter.pieces(text), 1)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "piece"])

    kind = long.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, start_char long, end_char long, n_tokens long, overlap_tokens long, boundary string, piece string"
    return long.mapInPandas(cut, schema)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that had to be cut."""
    return p8_pieces(spark, sf_dir).filter("piece_no = 1").select("doc_id")

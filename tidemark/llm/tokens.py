"""Sizes in tokens of a public byte-level BPE tokenizer. Its file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that comes with these ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    """The tokenizer, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text_col: str, keep: dict[str, Column], path: str = TOKENIZER) -> DataFrame:
    """The columns of ``keep`` and n_tokens, the tokens of the whole text; 0 for null and ''."""
    picked = df.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("_text"))
    kept = [f for f in picked.schema.fields if f.name != "_text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], [*[f.name for f in kept], "n_tokens"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens long"])
    return picked.mapInArrow(count, schema)

"""Places where a model may stand in for a rule. A model is any callable over a batch of texts; it runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])


def labelled_by(model: Callable[[list[str]], Sequence[tuple[str, float]]], text: Column, blank: tuple[str, float], most_chars: int | None = None) -> Column:
    """struct(label, confidence) for each text; null and blank texts take ``blank`` and never reach the model."""

    def run(texts: pd.Series) -> pd.DataFrame:
        whole = texts.fillna("")
        asked = [t[:most_chars] if most_chars else t for t in whole if t.strip()]
        answers = iter(model(asked) if asked else ())
        return pd.DataFrame([next(answers) if t.strip() else blank for t in whole], columns=["label", "confidence"])

    return F.pandas_udf(run, LABELLED)(text)


def embedded_by(model: Callable[[list[str]], Sequence[Sequence[float]]], text: Column) -> Column:
    """array<float> for each text; a null text is read as ''."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def vector_columns(vector: str, size: int, prefix: str) -> list[Column]:
    """The first ``size`` numbers of a vector as columns prefix_0, prefix_1, ...; null where the vector is shorter."""
    return [F.get(F.col(vector), F.lit(k)).alias(f"{prefix}_{k}") for k in range(size)]

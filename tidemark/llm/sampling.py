"""A bounded sample that a model is fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows are first thinned to about so many times the sample, so that what tasks send on doesn't grow with their number.
SPARE = 3


def fixed_sample(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most ``n`` rows, those with the lowest hash of ``key``; ``total`` is about how many rows there are.

    The same rows give the same sample on any number of tasks. Null keys are hashed too."""
    share = min(1.0, SPARE * n / max(1, total))
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    thinned = rows.filter(spot < F.lit(int(share * (1 << 30)))) if share < 1 else rows
    return thinned.orderBy(spot, key).limit(n)

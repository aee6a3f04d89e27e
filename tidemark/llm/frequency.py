"""Problem 4: how often every term occurs, in how many records, and which terms are too rare or too common.

Method: heavy-light aggregation. Terms that may hold at least ``HEAVY_SHARE`` of the rows are found first
(counters in the manner of Misra and Gries, at most 1 / HEAVY_SHARE of them, so the broadcast is bounded
whatever the data). Rows of these terms never leave their task: each task adds them into an array with one
exact counter for each heavy term and emits the array's used slots. Only the rows of the remaining terms are
shuffled by term. The two count tables are then united; which terms are heavy changes no figure.

Before that, all rows are shuffled once by record id, since records are delivered again; what is left, a term and a count
for each record, is written to the checkpoint folder and read by each later step instead of being derived again. The counts
themselves are written too, as the marks need their sum first.

Defined results: rows with the same record id count once, the one with the latest load (null load times come
first; of equal times the larger count); a record whose term is null or blank is left out everywhere; counts
that are null or negative add 0; rows with a null id are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

#: A term is heavy if it may hold at least this share of the rows; at most 1 / HEAVY_SHARE terms are.
HEAVY_SHARE = 0.002
COMMON_SHARE, RARE_RECORDS, RARE_TOTAL = 0.005, 3, 5


def records(rows: DataFrame, id_col: str, term_col: str, count_col: str, loaded_col: str) -> DataFrame:
    """(term, count) of each record's latest row, the term trimmed and in lower case."""
    base = rows.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(loaded_col).alias("loaded"), F.col(count_col).alias("count"), F.lower(F.trim(F.col(term_col))).alias("term")
        ).alias("row"),
    )
    latest = base.filter("id is not null").groupBy("id").agg(F.max("row").alias("row")).select("row.*")
    every = latest.unionByName(base.filter("id is null").select("row.*"))
    return every.filter("term <> ''").select("term", F.greatest(F.coalesce("count", F.lit(0)), F.lit(0)).cast("long").alias("count"))


def heavy_terms(rows: DataFrame, term_col: str, share: float = HEAVY_SHARE) -> list[str]:
    """Every term that holds more than ``share`` of the rows is among them; at most 1 / share terms are returned."""
    named = rows.select(F.lower(F.trim(F.col(term_col))).alias("term")).filter("term <> ''")
    # Spark's freqItems keeps 1 / support counters on every task and merges them.
    items = named.stat.freqItems(["term"], support=max(share, 1e-4)).first()
    return sorted(items[0] or []) if items else []


def term_frequencies(rows: DataFrame, id_col: str, term_col: str, count_col: str, loaded_col: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(term, records, total) for every distinct term."""
    spark = rows.sparkSession
    held = cut(records(rows, id_col, term_col, count_col, loaded_col))
    heavy = heavy_terms(held, "term", share)
    light = held
    counted = None
    if heavy:
        slots = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": heavy, "slot": range(len(heavy))}), "term string, slot int"))
        placed = held.join(slots, "term", "left")
        light = placed.filter("slot is null").select("term", "count")
        size = len(heavy)

        def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, sums = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for batch in batches:
                slot = batch.column(0).to_numpy(zero_copy_only=False)
                count = batch.column(1).to_numpy(zero_copy_only=False)
                hits += np.bincount(slot, minlength=size)
                np.add.at(sums, slot, count)
            used = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(hits[used]), pa.array(sums[used])], ["slot", "records", "total"]
            )

        arrays = placed.filter("slot is not null").select("slot", "count").mapInArrow(counters, "slot int, records long, total long")
        counted = arrays.groupBy("slot").agg(F.sum("records").alias("records"), F.sum("total").alias("total")).join(slots, "slot")
        counted = counted.select("term", "records", "total")
    rest = light.groupBy("term").agg(F.count("*").alias("records"), F.sum("count").alias("total"))
    return rest if counted is None else rest.unionByName(counted)


def marked(counts: DataFrame, common_share: float = COMMON_SHARE, rare_records: int = RARE_RECORDS, rare_total: int = RARE_TOTAL) -> DataFrame:
    """``counts`` with mark 'common', 'rare' or null."""
    counts = cut(counts)
    n = counts.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).scalar()
    mark = F.when(F.col("records") > F.lit(common_share) * n, "common").when(
        (F.col("records") < rare_records) | (F.col("total") < rare_total), "rare"
    )
    return counts.withColumn("mark", mark)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/term_counts.parquet")
    return marked(term_frequencies(rows, "term_id", "term", "count", "loaded_at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).filter("mark is not null").select("term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its figures and its mark, '' where there is none."""
    return _counts(spark, sf_dir).select("term", "records", "total", F.coalesce("mark", F.lit("")).alias("mark"))


_SQL = """
WITH latest AS (
  SELECT term, "count" AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY loaded_at DESC NULLS LAST, "count" DESC NULLS LAST, lower(trim(term)) DESC NULLS LAST) AS k
    FROM term_counts)
  WHERE k = 1 OR term_id IS NULL),
counts AS (
  SELECT lower(trim(term)) AS term, count(*) AS records, CAST(sum(greatest(coalesce(c, 0), 0)) AS BIGINT) AS total
  FROM latest WHERE trim(term) <> '' GROUP BY 1),
marked AS (
  SELECT *, CASE WHEN records > 0.005 * (SELECT sum(records) FROM counts) THEN 'common'
                 WHEN records < 3 OR total < 5 THEN 'rare' ELSE '' END AS mark FROM counts)
"""
SQL = {
    "p4_found": _SQL + "SELECT term, mark FROM marked WHERE mark <> ''",
    "p4_counts": _SQL + "SELECT term, records, total, mark FROM marked",
}

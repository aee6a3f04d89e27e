"""Files in and out: discovery, catalogue, profiles, conversion, JSON trends, reports, model registry."""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.standardise import detect_dataset_type

COMMENT_NAMES, VIDEO_NAMES = re.compile("comment|reply|replies"), re.compile("video|content|post")


def _at(spark: SparkSession, path: str):
    """The file system of a path, on whatever store it is, and the path there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def tables_below(spark: SparkSession, folder: str, kinds: Sequence[str]) -> list[str]:
    """Paths of files, and of folders that are tables, with one of the suffixes; part files of such a folder aren't listed."""
    fs, root = _at(spark, folder)
    found, todo = [], [root]
    while todo:
        for status in fs.listStatus(todo.pop()):
            path = status.getPath()
            if path.getName().endswith(tuple(kinds)):
                found.append(path.toString())
            elif status.isDirectory():
                todo.append(path)
    return sorted(p.removeprefix("file:") for p in found)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text, written by the driver to any store."""
    fs, there = _at(spark, path)
    out = fs.create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def discover(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Tables of a folder by kind: by their names first, else by the columns in the footer or header."""
    found: dict[str, list[str]] = {"comments": [], "videos": []}
    for path in tables_below(spark, folder, (".parquet", ".csv", ".json")):
        name = path.rpartition("/")[2].rpartition(".")[0].lower()
        kind = "comments" if COMMENT_NAMES.search(name) else "videos" if VIDEO_NAMES.search(name) else None
        if kind is None:
            kind = detect_dataset_type(read_any(spark, path).columns)
        if kind:
            found[kind].append(path)
    return found


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with a header, or JSON (a list of rows or one object) by the suffix; nested JSON objects become columns."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if suffix == ".json":
        return flattened(spark.read.json(path, multiLine=True))
    raise ValueError(f"no reader for {suffix!r} files")


def flattened(df: DataFrame) -> DataFrame:
    """Fields of structs as columns named 'outer.inner', at any depth."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [x for f in schema.fields for x in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)])]

    paths = leaves(df.schema, ())
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in paths])


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, suffix, size_bytes) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    # The scheme and root differ between file systems; what follows the folder's own path is kept.
    relative = F.regexp_replace("path", rf"^.*?\Q{os.path.abspath(folder).rstrip('/')}\E/", "")
    return files.select(relative.alias("relative_path"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.col("length").alias("size_bytes")).orderBy("relative_path")


def csv_profile(spark: SparkSession, path: str, sample_rows: int = 50_000, out: str | None = None) -> DataFrame:
    """(column, type, lines): types as inferred from a sample, physical lines less the header of each file; the sample can be
    kept as Parquet."""
    sample = spark.read.csv(path, header=True, inferSchema=True).limit(sample_rows)
    if out:
        sample.write.mode("overwrite").parquet(out)
    text = spark.read.text(path).select(F.input_file_name().alias("file"))
    counted = text.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).first()
    lines = max(0, counted.n - counted.files)
    return spark.createDataFrame([(n, t, lines) for n, t in sample.dtypes], "column string, type string, lines long")


def csv_to_parquet(spark: SparkSession, path: str, out: str) -> None:
    """Writes nothing where the output exists."""
    spark.read.csv(path, header=True, inferSchema=True).write.mode("ignore").parquet(out)


def all_csv_to_parquet(spark: SparkSession, root: str, out_dir: str) -> list[str]:
    """Every CSV below a folder, each to a folder named by its path, so that equal names don't collide."""
    fs, there = _at(spark, root)
    base = fs.makeQualified(there).toString().removeprefix("file:").rstrip("/")
    done = []
    for path in tables_below(spark, root, (".csv",)):
        out = f"{out_dir.rstrip('/')}/{path.removeprefix(base).lstrip('/').removesuffix('.csv')}.parquet"
        csv_to_parquet(spark, path, out)
        done.append(out)
    return done


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, distinct_values) of each column, from one pass over the table."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"`{n}`").cast("string").alias("value")) for n, t in df.dtypes]))
    each = df.select(cells.alias("_c")).select("_c.*")
    return each.groupBy("column", "type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("value").alias("distinct_values"))


def profile_report(spark: SparkSession, folder: str, path: str) -> list[str]:
    """Markdown with the profile of each table of a folder; the tables' paths."""
    done, lines = tables_below(spark, folder, (".parquet", ".csv", ".json")), ["# Tables"]
    for one in done:
        lines += ["", f"## {one.rpartition('/')[2]}", "", "| column | type | rows | nulls | distinct values |", "|-|-|-|-|-|"]
        lines += [f"| {r.column} | {r.type} | {r.rows} | {r.nulls} | {r.distinct_values} |" for r in table_profile(read_any(spark, one)).orderBy("column").collect()]
    write_text(spark, "\n".join(lines) + "\n", path)
    return done


def excel_to_frame(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, read on the driver; needs an Excel reader for pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=0))


def unzip(archive: str, dest: str) -> list[str]:
    """Unpacks into ``dest``; members that would land outside are refused."""
    root = Path(dest).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name!r} leads out of the folder")
        z.extractall(root)
        return z.namelist()


def weekly_trends(spark: SparkSession, path: str) -> DataFrame:
    """(category, window_start, term, tfidf_score) from a report with nested weekly terms."""
    term = "struct<term:string,tfidf_score:double>"
    schema = f"temporal_trends map<string,struct<total_posts:long,trending_terms_by_window:map<string,array<{term}>>>>"
    report = spark.read.schema(schema).json(path, multiLine=True)
    by_category = report.select(F.explode("temporal_trends").alias("category", "_t"))
    by_window = by_category.select("category", F.explode("_t.trending_terms_by_window").alias("_w", "_terms"))
    return by_window.select("category", F.to_date(F.substring("_w", 1, 10)).alias("window_start"), F.explode("_terms").alias("_x")).select("category", "window_start", "_x.*")


def decay_report(spark: SparkSession, path: str) -> DataFrame:
    """(category, term, trend_state, decay_confidence) from a lifecycle report; the wrapper around categories may be absent."""
    states = "map<string,map<string,struct<trend_state:string,decay_confidence:double>>>"
    report = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.term_decay_analysis"), F.col("value"))
    return report.select(F.explode(F.from_json(inner, states)).alias("category", "_terms")).select("category", F.explode("_terms").alias("term", "_x")).select("category", "term", "_x.*")


def nested_trends(weekly: DataFrame, path: str) -> None:
    """Writes long weekly rows back as the nested report; the rows of one category and week are collected, not more."""
    terms = F.array_sort(F.collect_list(F.struct((-F.col("tfidf_score")).alias("_o"), "term", "tfidf_score")))
    by_window = weekly.groupBy("category", "window_start").agg(F.transform(terms, lambda x: F.struct(x["term"].alias("term"), x["tfidf_score"].alias("tfidf_score"))).alias("_t"))
    by_category = by_window.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct(F.col("window_start").cast("string"), "_t"))).alias("trending_terms_by_window"))
    whole = by_category.agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("trending_terms_by_window")))).alias("temporal_trends"))
    write_report(json.loads(whole.toJSON().first()), path, weekly.sparkSession)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), skip_empty: bool = False) -> bool:
    """Snappy Parquet; False if nothing was written because the table was empty."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", "snappy").parquet(path)
    return True


def as_text_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for readers that know no nested types."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))})


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """JSON on any store."""
    write_text(spark or SparkSession.active(), json.dumps(report, indent=2, ensure_ascii=False, default=str), path)


def markdown_report(catalogued: DataFrame, path: str, rows: int = 50) -> None:
    """The first rows of a catalogue as a table."""
    head = catalogued.orderBy("relative_path").limit(rows).collect()
    lines = ["| path | suffix | bytes |", "|-|-|-|", *[f"| {r.relative_path} | {r.suffix} | {r.size_bytes} |" for r in head]]
    write_text(catalogued.sparkSession, "\n".join(lines) + "\n", path)


def save_model(model: PipelineModel, vocabulary: DataFrame, path: str, facts: dict) -> None:
    """A fitted pipeline, its vocabulary with weights, and facts about it; no pickles."""
    model.write().overwrite().save(f"{path}/model")
    write_table(vocabulary, f"{path}/vocabulary")
    write_report(facts, f"{path}/registry.json", vocabulary.sparkSession)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary"), json.loads(read_text(spark, f"{path}/registry.json"))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, fingerprint): audio files with the md5 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,mp3,flac,ogg,m4a}").load(folder)
    return files.select("path", "length", F.md5("content").alias("fingerprint"))

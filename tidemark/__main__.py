"""python -m tidemark FOLDER OUT [--config FILE]: all stages over the comment and video files of a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tidemark.plans import pipeline
from tidemark.session import ship
from tidemark.sources import files, synthetic


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("folder", nargs="?", help="folder with Parquet, CSV or JSON files; made-up posts where it is absent")
    parser.add_argument("out", help="folder for the tables and report.json")
    parser.add_argument("--config", help="JSON file whose sections go over the defaults")
    parser.add_argument("--rows", type=int, default=10_000, help="made-up posts")
    args = parser.parse_args(argv)
    config = json.loads(open(args.config).read()) if args.config else None
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    found = files.discover(spark, args.folder) if args.folder else {}
    raw = [files.read_any(spark, p) for paths in found.values() for p in paths] or [synthetic.synthetic_posts(spark, args.rows)]
    stages = pipeline.run(*raw, config=config)
    # Later stages read the posts from where they were written, not by computing them again.
    files.write_table(stages["posts"], f"{args.out}/posts")
    stages = pipeline.after_posts(spark.read.parquet(f"{args.out}/posts"), config)
    report = {"files": found, "config": pipeline.merged(config), "rows": {}}
    for name, df in stages.items():
        if name != "posts":
            files.write_table(df, f"{args.out}/{name}", ("interval",) if name == "series" else ())
        report["rows"][name] = spark.read.parquet(f"{args.out}/{name}").count()
    files.write_report(report, f"{args.out}/report.json")
    return report


if __name__ == "__main__":
    main()

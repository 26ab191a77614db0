"""python -m parallax compare OLD NEW [--out FOLDER] [--optimal] | analyze FOLDER | doctor"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parallax.operators import codefront, reports
from parallax.plans import comparison
from parallax.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parallax", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--include", nargs="*", default=[])
    c.add_argument("--exclude", nargs="*", default=[])
    c.add_argument("--threshold", type=float, default=0.7)
    c.add_argument("--limit", type=int, default=100)
    c.add_argument("--style", default="text", choices=("text", "markdown", "html", "xml"))
    c.add_argument("--out")
    a = sub.add_parser("analyze")
    a.add_argument("folder")
    sub.add_parser("doctor")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("parallax").getOrCreate()
    if args.command == "compare":
        found = comparison.compare_folders(spark, args.old, args.new, comparison.Config(threshold=args.threshold), include=tuple(args.include), exclude=tuple(args.exclude))
        print(reports.render(found.summary(), args.style))
        print(reports.render(found.changed(limit=args.limit).select("change_type", "name", F.col("source.file_path").alias("source"), F.col("target.file_path").alias("target"), "similarity", "magnitude"), args.style))
        if args.out:
            found.save(args.out, "comparison")
    elif args.command == "analyze":
        own = files.sources(spark, args.folder)
        fns = codefront.with_measures(codefront.functions(own.select(F.col("rel_path").alias("path"), "content")))
        print(reports.render(fns.groupBy("file_path").agg(F.count("*").alias("functions"), F.sum("loc").alias("lines"), F.max("cyclomatic").alias("max_cyclomatic")).orderBy("file_path")))
    else:
        print(f"spark {spark.version}; languages: {', '.join(codefront.SIGNS)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line (API-04): ``spark-submit`` front ends of the plans over a pages table."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from terrasift.operators import gate, index
from terrasift.plans import acquisition, pipeline
from terrasift.sinks import kml


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="terrasift", description="Coordinate tables of page text, validated and exported.")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (("run", "status of every document, KML of those that pass"), ("plan", "pages that the indexes lead to"), ("analyze", "how useful the indexes are"), ("failures", "what each table offered and what was read")):
        one = commands.add_parser(name, help=text)
        one.add_argument("pages", help="Parquet of doc_id, page_no, source_method, text")
        one.add_argument("target", help="folder for the output")
    climb = commands.add_parser("climb", help="the acquisition ladder over a text layer and OCR pages")
    climb.add_argument("pages")
    climb.add_argument("ocr", help="Parquet of OCR pages")
    climb.add_argument("target")
    climb.add_argument("--defer", action="store_true", help="stop at any usable result")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("terrasift").getOrCreate()
    pages = spark.read.parquet(args.pages)
    if args.command == "plan":
        kml.table(index.plan(pages), args.target)
    elif args.command == "analyze":
        kml.table(index.analysis(pages), args.target)
    elif args.command == "climb":
        kml.table(acquisition.climb(acquisition.stages(pages, spark.read.parquet(args.ocr)), args.defer).best, args.target)
    else:
        project = pipeline.run(pages)
        if args.command == "failures":
            kml.table(gate.failure_report(project.tables, project.points), args.target)
        else:
            kml.export(project.rings, project.gate, project.reasons, args.target)
            kml.table(pipeline.status(project), f"{args.target}/status")
            kml.table(gate.as_text(project.diagnostics), f"{args.target}/diagnostics")
    return 0


if __name__ == "__main__":
    sys.exit(main())

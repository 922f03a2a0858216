"""``python -m segmill.cli``: ``run`` aligns Parquet tables of segments and pages and writes the report; ``preprocess`` works
on rasters and labels; ``scan`` reads SVG files, ``pages`` PDF files.

Exit codes: 0 done, 2 for inputs or settings that can't be used, 1 for anything else."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from segmill import config, sinks
from segmill.metrics import Run
from segmill.operators import segments
from segmill.plans import pipeline, preprocess
from segmill.sources import pdf, svg


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="segmill")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="align segments_pdf with segments_svg (Parquet) and write the report")
    scan = sub.add_parser("scan", help="read SVG files into a table of segments")
    pre = sub.add_parser("preprocess", help="orientation and scale from rasters, checked by labels (Parquet tables)")
    pdfs = sub.add_parser("pages", help="read PDF files into tables of pages, segments, texts and drawings")
    for s in (run, scan, pre, pdfs):
        s.add_argument("--config")
        s.add_argument("--opts", action="append", default=[], metavar="path=value")
        s.add_argument("--out", required=True)
    run.add_argument("--pdf", required=True)
    run.add_argument("--svg", required=True)
    run.add_argument("--pages", required=True)
    run.add_argument("--raster", action="store_true", help="the page's segments come from a raster")
    scan.add_argument("--path", required=True)
    pdfs.add_argument("--path", required=True)
    pdfs.add_argument("--page", type=int, help="one page of each file, from 0; all by default")
    for name in ("--pixels", "--lines", "--texts"):
        pre.add_argument(name, required=True)
    for name in ("--rows", "--cols"):
        pre.add_argument(name, required=True, type=int)
    pre.add_argument("--pixels-per-unit", type=float, default=1.0)
    a = p.parse_args(argv)
    try:
        cfg = config.load(a.config, a.opts)
        spark = SparkSession.builder.appName("segmill").getOrCreate()
        if a.command == "scan":
            svg.segments(svg.read(spark, a.path), tol=cfg["svg"]["curve_tol"]).write.mode("overwrite").parquet(a.out)
            return 0
        if a.command == "pages":
            files, tol = pdf.read(spark, a.path), cfg["svg"]["curve_tol"]
            made = {"pages": pdf.pages(files), "segments": pdf.segments(files, page=a.page, tol=tol), "texts": pdf.texts(files, page=a.page), "drawings": pdf.drawings(files, page=a.page, tol=tol)}
            for name, df in made.items():
                df.write.mode("overwrite").parquet(f"{a.out}/{name}")
            return 0
        took = Run()
        if a.command == "preprocess":
            with took.stage("preprocess"):
                lines = segments.features(spark.read.parquet(a.lines), cfg["features"]["axis_tol_deg"])
                preprocess.run(spark.read.parquet(a.pixels), lines, spark.read.parquet(a.texts), rows=a.rows, cols=a.cols, pixels_per_unit=a.pixels_per_unit).write.mode("overwrite").parquet(a.out)
            print(took.report())
            return 0
        with took.stage("align"):
            out = pipeline.run(spark.read.parquet(a.pdf), spark.read.parquet(a.svg), spark.read.parquet(a.pages), config.for_rasters(cfg) if a.raster else cfg)
        with took.stage("write"):
            sinks.write_report(out["report"], f"{a.out}/report")
            out["models"].write.mode("overwrite").parquet(f"{a.out}/models")
            out["matches"].write.mode("overwrite").parquet(f"{a.out}/matches")
        took.count("documents", out["models"].count())
        print(took.report())
    except (ValueError, FileNotFoundError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"unexpected error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

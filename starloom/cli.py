"""Command line: ``python -m starloom.cli stars|quality|fast|facts|convert|query|list ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="starloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("stars", "quality", "fast", "facts"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--top", type=int, default=20)
        c.add_argument("--tsv")
    c = sub.add_parser("convert")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--quality", type=int, default=95)
    c.add_argument("--downscale", type=int, default=1)
    c.add_argument("--kind", choices=("png", "jpeg"), default="jpeg")
    c.add_argument("--preview", action="store_true")
    c = sub.add_parser("query")
    c.add_argument("name")
    c.add_argument("tables")
    c.add_argument("--top", type=int, default=20)
    sub.add_parser("list")
    a = p.parse_args(argv)
    from . import api, catalogue

    if a.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("starloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        catalogue.QUERIES[a.name](spark, a.tables).show(a.top, truncate=False)
    elif a.command == "convert":
        encoded = api.FrameConverter(spark, a.quality, a.downscale, preview=a.preview).convert(a.path, a.kind)
        api.save_images(encoded, a.out, "jpg" if a.kind == "jpeg" else "png").select("file", "bytes").show(1000, truncate=False)
    else:
        analyzer = api.FrameAnalyzer(spark)
        df = analyzer.facts(api.read_frames(spark, a.path)) if a.command == "facts" else getattr(analyzer, a.command)(a.path)
        if a.tsv:
            df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(a.tsv)
        else:
            (df.orderBy("flux", ascending=False) if a.command in ("stars", "fast") else df).show(a.top)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m vecloom -b | -s | -bs [-c settings.xml] [-D name=value ...] [--iterative] [--strict]

-b builds an index from the data set's text file and stores it, -s searches a stored index and reports, -bs does both.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vecloom import settings
from vecloom.plans import engine
from vecloom.plans.report import report, write_report
from vecloom.sources import text


def run(spark: SparkSession, argv: list[str]) -> str | None:
    """Does what the command line says; the report of a search."""
    parser = argparse.ArgumentParser("vecloom")
    mode = parser.add_mutually_exclusive_group(required=True)
    for flag, what in (("-b", "build"), ("-s", "search"), ("-bs", "both")):
        mode.add_argument(flag, dest="mode", action="store_const", const=what)
    parser.add_argument("-c", dest="file")
    parser.add_argument("-D", dest="values", action="append", default=[])
    parser.add_argument("--iterative", action="store_true")
    parser.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    values = settings.properties(spark, args.file) if args.file else {}
    own = settings.settings(values | dict(v.split("=", 1) for v in args.values))
    config, phases = own.config, engine.Phases()
    if args.mode != "search":
        points = text.read_points(spark, own.path("data"))
        asked = text.read_queries(spark, own.path("queries"), config.query_count) if "queries" in own.paths else None
        index = phases.timed("statistics", lambda: engine.build(points, config, asked))
        phases.timed("build", lambda: engine.save(index, own.path("index")))
    if args.mode == "build":
        return None
    index = engine.load(spark, own.path("index"))
    queries = text.read_queries(spark, own.path("queries"), config.query_count)
    found = engine.answer(index, queries, args.iterative, args.strict)
    target = own.paths.get("results") or f"{own.path('index')}/results"
    phases.timed("search", lambda: found.results.write.mode("overwrite").parquet(target))
    results = spark.read.parquet(target)
    truth = text.read_ground_truth(spark, own.path("truth"), config.query_count, index.config.k)
    out = report(results, truth, index.config.k, config.query_count, phases, found.radii)
    if "report" in own.paths:
        write_report(spark, out, own.path("report"))
    return out


def main() -> None:
    import sys

    print(run(SparkSession.builder.appName("vecloom").getOrCreate(), sys.argv[1:]) or "built")


if __name__ == "__main__":
    main()

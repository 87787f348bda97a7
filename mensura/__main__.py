"""Commands: python -m mensura COMMAND ...; each reads what it is pointed at and writes tables or documents."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

VERSION = "0.2"


def _layout(spark: SparkSession, args) -> int:
    """From a table of points (scene, x, y, z, nx, ny, nz) to tables of levels, lines, rooms and outlines."""
    from .plans.layout import layout

    for name, df in layout(spark.read.parquet(args.points)).items():
        df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
    return 0


def _inspect(spark: SparkSession, args) -> int:
    """Tiers of the captures below a folder."""
    from .sources import captures

    captures.detect(captures.listing(spark, args.path), args.path).orderBy("capture").show(10_000, False)
    return 0


def _validate(spark: SparkSession, args) -> int:
    """Says which items of a table (tier, kind, value, lo, hi) hold impossible values; fails if any does."""
    bad = spark.read.parquet(args.items).where("value is null or lo > value or value > hi or lo < 0")
    n = bad.count()
    bad.show(20, False)
    return int(n > 0)


def _schema(spark: SparkSession, args) -> int:
    from .sinks.documents import json_schema

    print(json.dumps(json_schema(spark.read.parquet(args.table).schema, args.title), indent=2))
    return 0


def _score(spark: SparkSession, args) -> int:
    """Gates and coverage of items (capture, tier, kind, room, ref, truth, value, lo, hi), as a report."""
    from pyspark.sql import functions as F

    from .operators import scoring
    from .sinks.documents import benchmark_report

    items = spark.read.parquet(args.items)
    gates = [g.select(F.lit(name).alias("name"), "tier", "n", "within", "passed") for name, g in (("wall lengths", scoring.wall_gate(items)), ("ceiling heights", scoring.ceiling_gate(items)))]
    print(benchmark_report("Benchmark", gates[0].unionByName(gates[1]), {"Interval coverage": scoring.calibration_table(items)}))
    return 0


def _calibrate(spark: SparkSession, args) -> int:
    """Fits factors to items and writes the next calibration document."""
    from .operators import calibration
    from .sinks.documents import folded_calibration

    items = spark.read.parquet(args.items)
    factors = {(r.tier, r.kind): r.factor for r in calibration.factors(items).where("factor is not null").collect()}
    scale = calibration.depth_scale(items).first()
    with open(args.document, encoding="utf-8") as f:
        print(folded_calibration(f.read(), factors, args.items, args.date, scale.ratio if scale and scale.adopted else None))
    return 0


def _query(spark: SparkSession, args) -> int:
    from .plans.catalogue import QUERIES

    QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


COMMANDS = {
    "run": (_layout, ["points", "out"]), "inspect": (_inspect, ["path"]), "validate": (_validate, ["items"]), "schema": (_schema, ["table", "title"]),
    "score": (_score, ["items"]), "calibrate": (_calibrate, ["items", "document", "date"]), "query": (_query, ["name", "tables", "out"]),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("mensura", description=__doc__)
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        sub = commands.add_parser(name, help=f.__doc__)
        for a in arguments:
            sub.add_argument(a)
    args = parser.parse_args(argv)
    return COMMANDS[args.command][0](SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())

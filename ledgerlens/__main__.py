"""Run the reports over a data folder and write them as Parquet.

    python -m ledgerlens --input BASE [--format csv] [--database payments]
                         --out OUT [--report NAME ...] [--canonical]

Reads ``BASE/<database>/{accounts,merchants,transactions,fraud_flags}``, writes
every input row once, judged, to ``OUT/_staged/<table>``, rejected rows to
``OUT/_rejected/<table>``, the typed model to ``OUT/_model`` (transactions partitioned
by month; every report then scans it instead of re-parsing the input) and each report to ``OUT/<report>`` (the
``vw_*`` views partitioned by month where they have one).  Uses the active
Spark session if there is one (e.g. under spark-submit).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ledgerlens.plans import catalog, views
from ledgerlens.schema import DEFAULT_DATABASE
from ledgerlens.sources.tables import (
    TABLE_NAMES,
    Tables,
    canonical_case,
    ingest_marked,
    load_tables,
    namespace_path,
    read_raw,
    split_marked,
    write_tables,
)


def model_reports() -> dict[str, catalog.Report]:
    """Registered reports that run on the four model tables."""
    return {r.name: r for r in catalog.REPORTS if r.bundle in ("orders", "events")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="python -m ledgerlens", description=__doc__.split("\n")[0])
    ap.add_argument("--input", required=True, help="base folder holding the database folder")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--database", default=DEFAULT_DATABASE)
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--report", action="append", choices=sorted(model_reports()),
                    metavar="NAME", help="report name (repeatable); default all")
    ap.add_argument("--canonical", action="store_true",
                    help="map case variants of status / reason values to their declared spelling")
    args = ap.parse_args(argv)

    spark = spark or SparkSession.builder.getOrCreate()
    out = args.out.rstrip("/")
    root = namespace_path(args.input, args.database)
    written, parsed = {}, {}
    for table in TABLE_NAMES:
        # every record is parsed and judged once; good and rejected rows are split on read
        staged = f"{out}/_staged/{table}"
        raw = read_raw(spark, f"{root}/{table}", table, args.format)
        ingest_marked(raw, table).write.mode("overwrite").parquet(staged)
        good, bad = split_marked(spark.read.parquet(staged))
        bad.write.mode("overwrite").parquet(f"{out}/_rejected/{table}")
        parsed[table] = canonical_case(good, table) if args.canonical else good
    write_tables(Tables(**parsed), f"{out}/_model", database=args.database)
    tables, _ = load_tables(spark, f"{out}/_model", "parquet", args.database)
    reports = model_reports()
    for name in args.report or list(reports):
        r = reports[name]
        writer = r.fn(tables, **r.params).write.mode("overwrite")
        parts = views.MART_PARTITIONS.get(name)
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(f"{out}/{name}")
        written[name] = f"{out}/{name}"
    return written


if __name__ == "__main__":
    main(sys.argv[1:])

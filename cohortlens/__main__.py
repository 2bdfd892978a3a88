"""Run the study on a visit table and write every output.

    python -m cohortlens --visits PATH [--format parquet|csv|table] [--csv-mode by_name|schema|infer]
                         [--out DIR] [--write-format parquet|csv] [--steps a,b,...] [--method exact|approx]

Each output is written by the executors (no collection on the driver) to
``DIR/<step>``; without ``--out`` the outputs go under the session's
checkpoint folder.  ``--list`` prints the step names.
"""

from __future__ import annotations

import argparse
import sys

from cohortlens.plans import checks as K
from cohortlens.plans import steps as T
from cohortlens.plans import study as S


def load_visits(spark, path: str, fmt: str, csv_mode: str, on_failed: str = "error"):
    """(visits, raw): the typed visit relation, and the table as stored when
    the visits are a projection of it (a wide CSV read by column name)."""
    from cohortlens.sources.bindings import read_visits
    from cohortlens.sources.csv import VISIT_SCHEMA, read_visits_csv, read_visits_csv_by_name
    if fmt == "table":
        return spark.read.table(path), None
    if fmt == "csv":
        if csv_mode == "by_name":
            raw = spark.read.option("header", True).csv(path)
            return read_visits_csv_by_name(spark, path, strict=False, on_failed=on_failed), raw
        return read_visits_csv(spark, path, schema=None if csv_mode == "infer" else VISIT_SCHEMA), None
    return read_visits(spark, path, fmt), None


def load_expected(spark, path: str | None) -> dict[str, float] | None:
    """Expected figures by check label (at most one per check)."""
    if not path:
        return None
    rows = spark.read.csv(path, header=True, schema="label string, expected double").limit(len(K.checks()) + 1).collect()
    return {r.label: r.expected for r in rows}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m cohortlens", description=__doc__.split("\n")[0])
    ap.add_argument("--visits", help="visit table: a path, or a table name with --format table")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json", "table"])
    ap.add_argument("--csv-mode", default="by_name", choices=["by_name", "schema", "infer"])
    ap.add_argument("--failed-cells", default="error", choices=["error", "null"],
                    help="CSV cells that are not blank and no number: refuse them, or read them as NULL")
    ap.add_argument("--out", help="output folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--write-format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--steps", help="comma-separated step names (default: all)")
    ap.add_argument("--method", default="exact", choices=["exact", "approx", "exact_sorted"],
                    help="quantile method of the default dimension output")
    ap.add_argument("--expected", help="CSV file (header label,expected) with the scorecard's expected figures")
    ap.add_argument("--no-shared", action="store_true",
                    help="run every step on its own (no shared statistics, counts and check tables)")
    ap.add_argument("--list", action="store_true", help="list the step names and exit")
    ap.add_argument("--master", help="Spark master (default: from the environment)")
    args = ap.parse_args(argv)

    if args.list:
        print("\n".join(T.STEPS))
        return 0
    if not args.visits:
        ap.error("--visits is required")

    from cohortlens.session import get_spark, scratch_dir
    spark = get_spark(args.master)
    visits, raw = load_visits(spark, args.visits, args.format, args.csv_mode, args.failed_cells)
    steps = [s for s in (args.steps or "").split(",") if s] or None
    outputs = T.run_study(visits, steps, raw=raw, shared=not args.no_shared, expected=load_expected(spark, args.expected))
    if args.method != "exact" and (steps is None or "run_dimension_default" in steps):
        outputs["run_dimension_default"] = S.run_dimension(visits, S.DEFAULT_DIMENSION, args.method)
    out = (args.out or scratch_dir(spark, "study")).rstrip("/")
    for name, df in outputs.items():
        writer = df.write.mode("overwrite")
        if args.write_format == "csv":
            writer = writer.option("header", True)
        writer.format(args.write_format).save(f"{out}/{name}")
        print(f"{name}\t{out}/{name}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())

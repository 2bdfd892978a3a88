"""The command-line study run over a wide header CSV (extra columns, shuffled
order), compared with the registered queries on the same data."""

from pyspark.sql import functions as F

from cohortlens.__main__ import main
from cohortlens.plans.registry import QUERIES
from cohortlens.session import scratch_dir
from cohortlens.sources import coded_visits
from conftest import SF001


def test_cli_runs_the_study_on_a_wide_csv(spark):
    v = coded_visits(spark, SF001)
    wide = v.select(F.lit("x").alias("DRUGID1"), *reversed(v.columns), F.lit(1.5).alias("EXTRA"))
    src = scratch_dir(spark, "cli-src")
    wide.write.option("header", True).csv(src)
    out = scratch_dir(spark, "cli-out")
    steps = "distribution_contrast,exclusion_waterfall,scorecard_summary,column_inventory,schema_validation"
    assert main(["--visits", src, "--format", "csv", "--out", out, "--steps", steps]) == 0
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/distribution_contrast").collect())
    want = sorted(tuple(r) for r in QUERIES["distribution_contrast"](spark, SF001).collect())
    assert got == want
    w = spark.read.parquet(f"{out}/exclusion_waterfall").first()
    assert w.total_records == 1500
    inv = spark.read.parquet(f"{out}/column_inventory").orderBy("ordinal_position").collect()
    assert len(inv) == 17 and inv[0].column_name == "DRUGID1"  # the file as stored, all columns
    assert all(r.ok for r in spark.read.parquet(f"{out}/schema_validation").collect())  # typed core columns


def test_cli_lists_steps(capsys):
    assert main(["--list"]) == 0
    assert "distribution_contrast" in capsys.readouterr().out


def test_cli_reports_missing_core_columns_and_goes_on(spark):
    v = coded_visits(spark, SF001).drop("PATWT", "EDWT")
    src = scratch_dir(spark, "cli-missing")
    v.write.option("header", True).csv(src)
    out = scratch_dir(spark, "cli-missing-out")
    assert main(["--visits", src, "--format", "csv", "--out", out,
                 "--steps", "required_columns,distribution_contrast"]) == 0
    req = {r.column_name: r.present for r in spark.read.parquet(f"{out}/required_columns").collect()}
    assert req["PATWT"] is False and req["EDWT"] is False and req["ARREMS"] is True
    assert spark.read.parquet(f"{out}/distribution_contrast").count() == 10


def test_cli_shared_and_independent_runs_agree(spark):
    src = scratch_dir(spark, "cli-shared-src")
    coded_visits(spark, SF001).write.parquet(src)
    a, b = scratch_dir(spark, "cli-a"), scratch_dir(spark, "cli-b")
    steps = "regional_contrast,exclusion_waterfall,scorecard"
    assert main(["--visits", src, "--out", a, "--steps", steps]) == 0
    assert main(["--visits", src, "--out", b, "--steps", steps, "--no-shared"]) == 0
    for name in steps.split(","):
        ra = sorted(map(tuple, spark.read.parquet(f"{a}/{name}").collect()), key=repr)
        rb = sorted(map(tuple, spark.read.parquet(f"{b}/{name}").collect()), key=repr)
        assert ra == rb, name


def test_cli_reads_a_catalog_table(spark):
    coded_visits(spark, SF001).createOrReplaceTempView("visits_table_for_cli")
    out = scratch_dir(spark, "cli-table-out")
    assert main(["--visits", "visits_table_for_cli", "--format", "table", "--out", out,
                 "--steps", "final_universe"]) == 0
    r = spark.read.parquet(f"{out}/final_universe").first()
    assert (r.total_records, r.clean_universe_final) == (1500, 903)

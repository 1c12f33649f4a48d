"""Command-line runner for registered queries."""

from acadia.plans import QUERIES, run

from .conftest import SF_SMALL


def test_list(capsys):
    assert run.main(["--list"]) == 0
    assert capsys.readouterr().out.split() == sorted(QUERIES)


def test_run_writes_parquet(spark, tmp_path):
    out = str(tmp_path / "daily")
    assert run.main(["sales_daily_range", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(out).count() == QUERIES["sales_daily_range"](spark, SF_SMALL).count()

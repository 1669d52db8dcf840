"""Command line: list, show and marts."""

from emporia.__main__ import main
from emporia.plans.catalog import ANALYSES
from tests.conftest import SF0001


def test_list(capsys):
    assert main(["list"]) == 0
    assert capsys.readouterr().out.split() == list(ANALYSES)


def test_show_and_marts(spark, capsys, tmp_path):
    assert main(["show", "repeat_rate", "--testdata", SF0001]) == 0
    assert "repeat_rate" in capsys.readouterr().out
    out = tmp_path / "marts"
    assert main(["marts", "--testdata", SF0001, "--out", str(out), "--only", "user_growth",
                 "--concurrency", "1"]) == 0
    written = spark.read.parquet(str(out / "user_growth")).count()
    assert written == ANALYSES["user_growth"].run(__import__("emporia").bind_testdata(spark, SF0001)).count()

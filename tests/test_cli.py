import json

import pytest

from gapfold import cli

DATA = "/root/testdata/sf0.001"


def test_grids(spark, tmp_path):
    for i, args in enumerate((["cartesiangrid", "-q", "reflectance > -20", "-m", "MIN"], ["cartesiangrid", "--plane"], ["scangrid", "--scan", "sp000001"], ["sphericalgrid", "-r", "5"], ["sphericalgrid", "-R", "10", "-a", "reflectance"], ["sphericalgrid", "--leaf"])):
        out = str(tmp_path / str(i))
        cli.main([*args, "--data", DATA, "--out", out], spark)
        g = spark.read.parquet(out)
        assert {"band", "row", "col", "value"} <= set(g.columns) and g.count() > 0


def test_profiles(spark, tmp_path):
    for i, args in enumerate((["--pgap-out", str(tmp_path / "gap")], ["--ground-plane", "--reportfile", str(tmp_path / "report"), "-m", "FIRST"], ["--leaf", "-m", "FIRSTLAST", "--min-zenith", "55", "--max-zenith", "60", "--azimuth-resolution", "360"], ["-m", "ALL"])):
        out = str(tmp_path / f"p{i}")
        cli.main(["plantprofile", *args, "--data", DATA, "--out", out], spark)
        assert spark.read.option("header", True).csv(out).count() == 100
    assert "Slope" in (tmp_path / "report").read_text() and "Zenith0375" in spark.read.option("header", True).csv(str(tmp_path / "gap")).columns


def test_voxels(spark, tmp_path):
    cli.main(["voxelization", "-v", "4", "-m", "1", "-w", "--data", DATA, "--out", str(tmp_path)], spark)
    for name in ("voxels", "model", "cover", "occlusion"):
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
    assert json.loads((tmp_path / "config.json").read_text())["nx"] == 12


def test_bad_filter(spark, tmp_path):
    with pytest.raises(ValueError):
        cli.main(["scangrid", "-q", "nothing > 1", "--data", DATA, "--out", str(tmp_path / "x")], spark)

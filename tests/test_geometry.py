import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapfold.functions import expr, predicate
from gapfold.sources import transforms


def test_floor_division(spark):
    rng = np.random.default_rng(1)
    a = np.r_[rng.normal(scale=50, size=500), np.arange(-40, 40) * 0.1, np.arange(-40, 40) * 0.5]
    df = spark.createDataFrame([(float(x),) for x in a], "a double")
    for b in (0.1, 0.5, 0.3, math.radians(5)):
        got = [r[0] for r in df.select(expr.bin_index(F.col("a"), b)).collect()]
        assert got == [int(x // b) for x in a]


def test_angles_round_trip(spark):
    rng = np.random.default_rng(1)
    z, az, r = rng.uniform(0.01, 3.1, 200), rng.uniform(0, 6.28, 200), rng.uniform(0.1, 90, 200)
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(r, z, az)], "r double, z double, a double")
    x, y, zz = expr.rza_to_xyz(F.col("r"), F.col("z"), F.col("a"))
    d = df.select("z", "a", x.alias("x"), y.alias("y"), zz.alias("zz"))
    bad = d.select(F.abs(expr.zenith_of(F.col("x"), F.col("y"), F.col("zz")) - F.col("z")) + F.abs(expr.azimuth_of(F.col("x"), F.col("y")) - F.col("a")))
    assert max(v[0] for v in bad.collect()) < 1e-9


def test_rotation_is_the_product(spark, tmp_path):
    m = expr.rotation_matrix(F.col("p"), F.col("r"), F.col("w"))
    row = spark.createDataFrame([(1.5, -2.5, 33.0), (1.0, 2.0, None)], "p double, r double, w double").select(*[c.alias(k) for k, c in m.items()]).collect()
    for got, pose in zip(row, ({"pitch": 1.5, "roll": -2.5, "yaw": 33.0}, {"pitch": 1.0, "roll": 2.0, "yaw": float("nan")})):
        (tmp_path / "pose.json").write_text(json.dumps(pose))
        want = transforms.read_pose(str(tmp_path / "pose.json"))
        for i in range(3):
            for j in range(3):
                assert got[f"m{i}{j}"] == pytest.approx(want[f"r{i}{j}"], abs=1e-12)


def test_transform_file(spark, tmp_path):
    (tmp_path / "t.DAT").write_text("0 -1 0 10\n1 0 0 20\n0 0 1 30\n0 0 0 1\n")
    t = transforms.read_transform(str(tmp_path / "t.DAT"))
    assert (t["r01"], t["r10"], t["tx"], t["ty"], t["tz"]) == (1.0, -1.0, 10.0, 20.0, 30.0)
    s = transforms.scans(spark, {"a": t})
    x, y, z = expr.rotate(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert tuple(s.select(x, y, z).first()) == (-2.0, 1.0, 3.0)
    (tmp_path / "bad.DAT").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        transforms.read_transform(str(tmp_path / "bad.DAT"))
    with pytest.raises(transforms.VendorFormat):
        transforms.read_vendor("x.rxp")


def test_guarded_log(spark):
    d = spark.createDataFrame([(1.0,), (0.5,), (0.0,), (-1.0,), (float("nan"),), (None,)], "p double")
    got = [-1.1 * r[0] for r in d.select(expr.guarded_ln(F.col("p"))).collect()]
    assert got == pytest.approx([0, 0.76246, 12.664218, 12.664218, 12.664218, 12.664218], abs=1e-5)


def test_predicates(spark):
    d = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, -30.0)], "id int, range1 double")
    ids = lambda q: [r.id for r in predicate.where(d, q).collect()]
    assert ids("range1 > -20") == [1] and ids(["range1 > -40", "(id != 1)"]) == [4] and ids("id >= 2.5e0") == [3, 4] and ids(None) == [1, 2, 3, 4]
    for bad in ("range1 > -20 and id < 3", "nonsense", "5 < id", "missing > 1"):
        with pytest.raises(ValueError):
            predicate.where(d, bad)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, 3.0)], "reflectance double, x double, unused double").write.parquet(str(tmp_path / "p"))
    d = predicate.where(spark.read.parquet(str(tmp_path / "p")), "reflectance > -20").select("x")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(reflectance,-20.0)" in plan and "unused" not in plan

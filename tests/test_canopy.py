"""Pulses, grids, profiles, ground and LEAF on small hand-worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapfold.functions import expr
from gapfold.operators import grids, ground, leaf, profiles, pulses
from gapfold.operators.profiles import Cube

POINT = "scan_id string, scanline int, scanline_idx int, target_index int, target_count int, riegl_id long, loaded_at int, x double, y double, z double, range double, reflectance double"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def test_distinct_and_reindex(spark):
    nan = float("nan")
    p = points(spark, [
        ("s", 0, 0, 1, 3, 1, 5, 1.0, 1.0, 1.0, 2.0, -5.0), ("s", 0, 0, 1, 3, 1, 9, 9.0, 9.0, 9.0, 2.0, -5.0), ("s", 0, 0, 2, 3, 2, 5, 1.0, 1.0, 1.0, 3.0, -30.0), ("s", 0, 0, 3, 3, 3, 5, 1.0, 1.0, 1.0, 4.0, -6.0),
        ("s", 0, 1, 1, 1, 4, 5, nan, 1.0, 1.0, 2.0, -5.0), ("s", 0, 1, 2, 1, 5, 5, None, 1.0, 1.0, 2.0, -5.0), ("s", None, 1, 1, 1, 6, 5, 0.0, 1.0, 1.0, 2.0, nan)])
    d = pulses.distinct_points(p)
    assert sorted((r.riegl_id, r.x) for r in d.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0), (6, 0.0)]
    r = pulses.reindex_targets(d, "reflectance > -20").collect()
    assert sorted((x.riegl_id, x.target_index, x.target_count) for x in r) == [(1, 1, 2), (3, 2, 2)]
    assert pulses.reindex_targets(d.limit(0)).count() == 0


def test_one_shuffle_for_dedupe_and_reindex(spark):
    p = points(spark, [("s", 0, 0, 1, 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0)])
    plan = pulses.reindex_targets(pulses.distinct_points(p), "reflectance > -20")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_counts_and_returns_by_pulse(spark):
    u = spark.createDataFrame([("s", 0, i, i, 0) for i in range(3)] + [("s", 0, 2, 2, 0)], "scan_id string, scanline int, scanline_idx int, pulse_id long, timestamp long")
    u = pulses.distinct_pulses(u)
    p = points(spark, [("s", 0, 1, 2, 2, 1, 1, 0.0, 0.0, 0.0, 7.0, 0.0), ("s", 0, 1, 1, 2, 2, 1, 0.0, 0.0, 0.0, 5.0, 0.0), ("s", 9, 9, 1, 1, 3, 1, 0.0, 0.0, 0.0, 5.0, 0.0)])
    n = {r.pulse_id: r.target_count for r in pulses.pulse_target_counts(u.withColumn("target_count", F.lit(9)), p).collect()}
    assert n == {0: 0, 1: 2, 2: 0}
    a = {r.pulse_id: [x["range"] for x in r.returns] for r in pulses.points_by_pulse(u, p, ["range"]).collect()}
    assert a == {0: [], 1: [5.0, 7.0], 2: []}
    assert pulses.attach_pulses(p, u, ["pulse_id"]).count() == 2


def test_grid_methods_and_bounds(spark):
    d = spark.createDataFrame([(1.0, 0, 0), (3.0, 0, 0), (float("nan"), 0, 0), (None, 0, 0), (-9999.0, 1, 0), (5.0, -1, 0), (5.0, 0, 7)], "v double, x int, y int")
    for method, want in (("MEAN", 2.0), ("SUM", 4.0), ("MAX", 3.0), ("MIN", 1.0)):
        got = {(r.y, r.x): (r.value, r.cnt) for r in grids.aggregate(d, F.col("v"), F.col("x"), F.col("y"), 0, (1, 2, 2), method).collect()}
        assert got == {(0, 0): (want, 2), (0, 1): (-9999.0, 1)}
    with pytest.raises(ValueError):
        grids.aggregate(d, F.col("v"), F.col("x"), F.col("y"), method="MODE")
    g = spark.createDataFrame([(0, y, x, float(y + x)) for y in range(4) for x in range(4)], "z int, y int, x int, value double")
    assert {(r.y, r.x): r.value for r in grids.overview(g, 2).collect()} == {(0, 0): 1.0, (0, 1): 3.0, (1, 0): 3.0, (1, 1): 5.0}


def test_target_weights_and_shots(spark):
    cube = Cube(hres=1, zres=10, ares=360, min_z=0, max_z=10, min_h=0, max_h=2)
    t = spark.createDataFrame([(0.1, 0.1, 0.5, 1, 1), (0.1, 0.1, 0.5, 1, 2), (0.1, 0.1, 0.5, 2, 2), (0.1, 0.1, float("nan"), 1, 1), (0.1, 0.1, 2.5, 1, 1), (1.5, 0.1, 0.5, 1, 1)], "zenith double, azimuth double, height double, target_index int, target_count int")
    for method, want in (("WEIGHTED", 2.0), ("FIRST", 2.0), ("ALL", 3.0), ("FIRSTLAST", 1.5)):
        assert [tuple(r) for r in profiles.targets(t, cube, method).collect()] == [(0, 0, 0, want)]
    s = spark.createDataFrame([(0.1, 0.1, n) for n in (0, 1, 2)], "zenith double, azimuth double, target_count int")
    assert profiles.shots(s, cube).first().n == 3 and profiles.shots(s, cube, "ALL").first().n == 3
    with pytest.raises(ValueError):
        profiles.target_weight("SOME")


def test_gap_falls_with_height_and_matches_arrays(spark):
    rng = np.random.default_rng(4)
    cube = Cube(hres=0.5, zres=5, ares=90, min_z=35, max_z=70, min_h=0, max_h=10)
    n = 4000
    zen, azi, cnt = rng.uniform(math.radians(30), math.radians(75), n), rng.uniform(0, 2 * math.pi, n), rng.integers(0, 3, n)
    sht = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(zen, azi, cnt)], "zenith double, azimuth double, target_count int")
    h = rng.uniform(-1, 12, (n, 2))
    rows = [(float(zen[i]), float(azi[i]), float(h[i, k]), k + 1, int(cnt[i])) for i in range(n) for k in range(cnt[i])]
    tgt = spark.createDataFrame(rows, "zenith double, azimuth double, height double, target_index int, target_count int")
    g = profiles.pgap(profiles.cover(profiles.targets(tgt, cube), profiles.shots(sht, cube), cube), cube)
    out, shots = np.zeros((cube.nz, cube.na, cube.nh)), np.zeros((cube.nz, cube.na))
    for z, a in zip(zen, azi):
        i, j = int((z - math.radians(35)) // math.radians(5)), int(a // math.radians(90))
        if 0 <= i < cube.nz:
            shots[i, j] += 1
    for z, a, hh, _, c in rows:
        i, j, k = int((z - math.radians(35)) // math.radians(5)), int(a // math.radians(90)), int(hh // 0.5)
        if 0 <= i < cube.nz and 0 <= k < cube.nh:
            out[i, j, k] += 1 / c
    want = 1 - (np.cumsum(out, 2) / shots[..., None]).mean(1)
    got = np.zeros_like(want)
    for r in g.collect():
        got[r.zi, r.hi] = r.pgap
    assert np.allclose(got, want) and (np.diff(got, axis=1) <= 1e-12).all()

    log = np.where(want > 0, np.log(np.where(want > 0, want, 1)), math.log(1e-5))
    x = np.array([expr.leaf_angle_x(cube.zenith(i)) for i in range(cube.nz)])
    lin = {r.hi: r for r in profiles.pai_linear(g, cube).collect()}
    for k in range(cube.nh):
        b, a = np.polyfit(x, -log[:, k], 1)
        pv, ph = (b, a)
        if b < 0:
            pv, ph = 0.0, -log[:, k].mean()
        if a < 0:
            pv, ph = (-log[:, k] / x).mean(), 0.0
        assert lin[k].paiv == pytest.approx(pv, abs=1e-9) and lin[k].paih == pytest.approx(ph, abs=1e-9)
    hinge = -1.1 * log[profiles.hinge_ring(cube)]
    assert [r.pai for r in profiles.pai_hinge(g, cube).orderBy("hi").collect()] == pytest.approx(list(hinge))
    w = np.array([2 * math.pi * math.sin(cube.zenith(i)) * math.radians(5) for i in range(cube.nz)])
    ratio = (w[:, None] / w.sum() * log / log[:, -1:]).sum(0)
    assert [r.pai for r in profiles.pai_weighted(g, cube).orderBy("hi").collect()] == pytest.approx(list(hinge.max() * ratio))
    assert profiles.plant_profiles(g, cube).count() == cube.nh and len(profiles.pgap_wide(g, cube).columns) == 1 + cube.nz


def test_profile_of_nothing(spark):
    cube = Cube(max_h=2)
    none = spark.createDataFrame([], "zenith double, azimuth double, height double, target_index int, target_count int")
    g = profiles.pgap(profiles.cover(profiles.targets(none, cube), profiles.shots(none, cube), cube), cube)
    assert g.count() == 0 and [round(r.pai, 5) for r in profiles.pai_hinge(g, cube).collect()] == [12.66422] * cube.nh


def test_density_profile(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "hi int, pai double")
    assert [r.pavd for r in profiles.pavd(d, 0.5).orderBy("hi").collect()] == [2, 3, 4]
    assert [r.pavd for r in profiles.pavd(d, 0.5, central=False).orderBy("hi").collect()] == [2, 4, -6]


def test_azimuth_selection():
    # middles 45, 135, 225, 315; the request is widened by half a bin on both sides
    assert profiles.azimuth_bins(Cube(ares=90), 90, 180) == [0, 1]
    assert profiles.azimuth_bins(Cube(ares=90), 90, 180, invert=True) == [2, 3]
    assert profiles.azimuth_bins(Cube(ares=90)) == [0, 1, 2, 3]


def test_lowest_return_and_plane(spark):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(-29, 29, 4000), rng.uniform(-29, 29, 4000)
    z = 1.0 + 0.05 * x - 0.03 * y + rng.exponential(2.0, 4000)
    low = rng.choice(4000, 900, replace=False)
    z[low] = 1.0 + 0.05 * x[low] - 0.03 * y[low]
    z[:3] = -40
    p = spark.createDataFrame([("s", i, float(a), float(b), float(c), 10.0) for i, (a, b, c) in enumerate(zip(x, y, z))], "scan_id string, riegl_id long, x double, y double, z double, range double")
    plane = ground.ground_plane(p, 60, 3)
    assert plane.a == pytest.approx(1.0, abs=0.1) and plane.b == pytest.approx(0.05, abs=0.01) and plane.c == pytest.approx(-0.03, abs=0.01)
    assert plane.slope == pytest.approx(3.34, abs=0.6) and "Slope" in plane.report()
    tie = spark.createDataFrame([("b", 1, 0.1, 0.1, 1.0, 2.0), ("a", 2, 0.2, 0.2, 1.0, 3.0), ("a", 3, 0.3, 0.3, float("nan"), 3.0)], p.schema)
    assert ground.min_z_grid(tie, 10, 10).first().r == 3.0
    with pytest.raises(ValueError):
        ground.plane_fit([1], [1], [1])


def test_leaf_shots(spark):
    s = spark.createDataFrame([
        ("TLF00001_0001_hemi_20250101-000000Z_0800_0400", 0, 6400.0, 0.0, 5.0, 10, 7.0, 10, 100.0, 1), ("TLF00001_0001_hemi_20250101-000000Z_0800_0400", 0, 1.0, 1.0, 1.0, 1, 1.0, 1, 1.0, 2),
        ("TLF00001_0001_hemi_20250101-000000Z_0800_0400", 1, 19200.0, 20000.0, 121.0, 10, 7.0, 0, 50.5, 1), ("x", 0, -1.0, 5000.0, 5.0, 0, float("nan"), None, None, 1)],
        "scan_id string, seq long, scan_encoder double, rotary_encoder double, range1 double, intensity1 int, range2 double, intensity2 int, sample_time double, loaded_at int")
    d = leaf.with_steps(leaf.invalidated(leaf.distinct_shots(s)))
    got = {(r.scan_id[:1], r.seq): r for r in leaf.heights(leaf.angles(d, F.col("nsteps")).withColumn("n", leaf.target_count()).withColumn("old", leaf.target_count(True)), 0.0).collect()}
    a, b, c = got[("T", 0)], got[("T", 1)], got[("x", 0)]
    assert (a.nsteps, c.nsteps) == (25600.0, 10000.0)
    assert a.zenith == pytest.approx(math.pi / 2) and a.azimuth == pytest.approx(math.pi) and (a.n, a.old) == (2, 2)
    assert b.zenith == pytest.approx(math.pi / 2) and b.azimuth == pytest.approx(2 * math.pi) and b.range1 is None and b.range2 is None and (b.n, b.old) == (0, 2)
    assert c.zenith is None and c.range1 is None and c.n == 0 and a.h1 == pytest.approx(0, abs=1e-9)
    t = {(r.scan_id[:1], r.seq): r.row_time for r in leaf.row_times(d).collect()}
    assert str(t[("T", 1)]) == "2025-01-01 00:00:00.150500" and t[("x", 0)] is None


def test_row_times_across_shards(spark, monkeypatch):
    d = spark.range(50).selectExpr("'TLF00001_0001_hemi_20250101-000000Z_0800_0400' as scan_id", "id as seq", "cast(id as double) as sample_time")
    want = {r.seq: r.row_time for r in leaf.row_times(d).collect()}
    monkeypatch.setattr(leaf, "SHARD_SHOTS", 7)
    assert {r.seq: r.row_time for r in leaf.row_times(d).collect()} == want


def test_leaf_cube_is_targets_and_shots(spark):
    rng = np.random.default_rng(9)
    rows = [("s", float(a), float(b), int(c), float(h1) if c else None, float(h2) if c > 1 else None) for a, b, c, h1, h2 in zip(rng.uniform(0, 1.4, 300), rng.uniform(0, 6.28, 300), rng.integers(0, 3, 300), rng.uniform(-1, 6, 300), rng.uniform(-1, 6, 300))]
    s = spark.createDataFrame(rows, "scan_id string, zenith double, azimuth double, target_count int, h1 double, h2 double")
    cube = Cube(hres=1, zres=10, ares=90, min_z=0, max_z=70, min_h=0, max_h=5)
    for method in profiles.METHODS:
        t, n = profiles.leaf_cube(s, cube, method)
        key = lambda d: sorted((*r[:-1], round(r[-1], 9)) for r in d.collect())
        assert key(t.select("zi", "ai", "hi", "w")) == key(profiles.targets(leaf.returns(s), cube, method))
        assert key(n) == key(profiles.shots(s, cube, method))

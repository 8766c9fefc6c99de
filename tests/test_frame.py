"""Shots and returns of a profile stand in one frame."""

import numpy as np
import pandas as pd

from gapfold.functions import expr
from gapfold.operators import pulses
from gapfold.plans import profiles as plan
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def directions(df, names, scans):
    j = df.merge(scans, on="scan_id")
    m = j[[f"r{i}{k}" for i in range(3) for k in range(3)]].to_numpy().reshape(-1, 3, 3)
    v = np.einsum("ni,nij->nj", j[names].to_numpy(float), m)
    length = np.sqrt((v**2).sum(1))
    zen = np.arccos(np.clip(v[:, 2] / np.where(length > 0, length, 1), -1, 1))
    azi = np.arctan2(v[:, 0], v[:, 1]) % (2 * np.pi)
    return j, v, np.where(length > 0, zen, np.nan), azi


def test_gap_from_rotated_directions(spark):
    read = lambda t: pd.read_parquet(f"{DATA}/{t}.parquet")
    scans, pul, pts = read("scans"), read("pulses"), read("points_rdb")
    key = ["scan_id", "scanline", "scanline_idx"]
    pul = pul.sort_values([*key, "pulse_id", "timestamp"]).drop_duplicates(key)
    pts = pts.dropna(subset=["x", "y", "z"]).sort_values([*key, "riegl_id", "loaded_at"]).drop_duplicates([*key, "riegl_id"])
    pts = pts[pts.reflectance > -20]
    pts["w"] = 1 / pts.groupby(key).riegl_id.transform("size")
    c = plan.CUBE
    cube, shots = np.zeros((c.nz, c.na, c.nh)), np.zeros((c.nz, c.na))
    for df, names in ((pul, [f"beam_direction_{a}" for a in "xyz"]), (pts, list("xyz"))):
        j, v, zen, azi = directions(df, names, scans)
        ok = (zen >= np.radians(c.min_z)) & (zen < np.radians(c.max_z))
        zi, ai = ((zen - np.radians(c.min_z)) // np.radians(c.zres)), azi // np.radians(c.ares)
        if names == list("xyz"):
            hi = (v[:, 2] + j.tz) // c.hres
            ok &= (hi >= 0) & (hi < c.nh)
            np.add.at(cube, tuple(q[ok].astype(int) for q in (zi, ai, hi)), j.w[ok])
        else:
            np.add.at(shots, tuple(q[ok].astype(int) for q in (zi, ai)), 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = 1 - np.nanmean(np.where(shots[..., None] > 0, cube.cumsum(2) / shots[..., None], np.nan), axis=1)
    got = {(r.zi, r.hi): r.pgap for r in plan.QUERIES["pgap_theta_z"](spark, DATA).collect()}
    assert len(got) == c.nz * c.nh
    assert max(abs(got[z, h] - want[z, h]) for z in range(c.nz) for h in range(c.nh)) < 1e-6


def test_floor_division(spark):
    cases = [(1.0, 0.1), (0.3, 0.1), (-0.1, 0.5), (7.0, 0.5), (-3.0, 1.5), (2.9999999999999996, 1.0), (0.0, 2.0), (-0.75, 0.25), (1e9, 0.1)]
    for a, b in cases:
        got = spark.range(1).select(expr.floor_div(F.lit(a), b)).first()[0]
        assert got == np.floor_divide(a, b), (a, b)


def test_returns_without_an_id_stay(spark):
    rows = [("s", 1, 1, None, 1, 1.0), ("s", 1, 1, None, 2, 2.0), ("s", 1, 1, 5, 1, 3.0), ("s", 1, 1, 5, 2, 4.0), ("s", 1, 2, None, 1, 5.0)]
    df = spark.createDataFrame([(s, a, b, i, t, v, v, v) for s, a, b, i, t, v in rows], "scan_id string, scanline int, scanline_idx int, riegl_id long, loaded_at int, x double, y double, z double")
    assert sorted(r.x for r in pulses.distinct_points(df).collect()) == [1.0, 2.0, 3.0, 5.0]

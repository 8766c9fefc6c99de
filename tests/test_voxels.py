import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapfold.operators import voxels
from gapfold.operators.voxels import COUNTS, Box

BOX = Box((0, 0, 0, 4, 3, 3), 1.0)


def stepwise(o, d, returns, ground, box):
    """One ray, voxel by voxel, from plane crossings sorted along the ray."""
    n, lo, hi = box.n, np.array(box.bounds[:3], float), np.array(box.bounds[3:], float)
    sums = {}
    near, far = -math.inf, math.inf
    for i in range(3):
        if d[i] == 0:
            if not lo[i] <= o[i] <= hi[i]:
                return sums
        else:
            a, b = (lo[i] - o[i]) / d[i], (hi[i] - o[i]) / d[i]
            near, far = max(near, min(a, b)), min(far, max(a, b))
    if near > far or far < 0:
        return sums
    t = max(0.0, near)
    cell = [min(int(math.floor((o[i] + t * d[i] - lo[i]) / box.size)), n[i] - 1) for i in range(3)]
    ends = []
    for i in range(3):
        if d[i]:
            k, m = cell[i] + (d[i] > 0), 0
            first = t + (lo[i] + k * box.size - (o[i] + t * d[i])) / d[i]
            ends += [(first + m * box.size / abs(d[i]), (2, 1, 0)[i], i) for m in range(40)]
    ends.sort()
    theta = math.acos(d[2] / math.sqrt(sum(x * x for x in d)))
    at = []
    for p in returns:
        c = [int(math.floor((p[i] - lo[i]) / box.size)) for i in range(3)]
        at.append(tuple(c) if all(0 <= c[i] < n[i] for i in range(3)) else None)
    w = 1 / len(returns) if returns else 0.0
    miss, occl, last, left = 1.0, 0.0, False, ends[0][0]
    for j, (_, _, axis) in enumerate(ends):
        if not all(0 <= cell[i] < n[i] for i in range(3)):
            break
        here = tuple(cell)
        cell[axis] += 1 if d[axis] > 0 else -1
        length = ends[j + 1][0] - left
        s = sums.setdefault(here, dict.fromkeys(COUNTS, 0.0))
        s["zeni"] += theta
        missed = False
        for p, g in zip(at, ground):
            if p == here:
                if g:
                    occl += w
                else:
                    s["hits"] += w
                    s["phit"] += length
                miss -= w
                last = True
            else:
                if last:
                    occl += w
                    last = False
                missed = True
        if abs(miss) < 1e-12:
            miss = 0.0
        s["occl"] += occl
        s["miss"] += miss
        if missed:
            s["pmiss"] += length
        left = ends[j + 1][0]
    return sums


def run(rays, box=BOX):
    k = max([1, *(len(r[2]) for r in rays)])
    o, d = np.array([r[0] for r in rays], float), np.array([r[1] for r in rays], float)
    xyz, gnd = np.zeros((len(rays), k, 3)), np.zeros((len(rays), k), bool)
    for i, r in enumerate(rays):
        for j, (p, g) in enumerate(zip(r[2], r[3])):
            xyz[i, j], gnd[i, j] = p, g
    out = {}
    nx, ny, _ = box.n
    for _, voxel, values in voxels.walk(o, d, xyz, gnd, np.array([len(r[2]) for r in rays]), box):
        for i, v in enumerate(voxel):
            s = out.setdefault((int(v % nx), int(v // nx % ny), int(v // (nx * ny))), np.zeros(6))
            s += [c[i] for c in values]
    return out


def along(returns, ground=None):
    """Voxels A to D in a row along x."""
    got = run([((-1.0, 0.5, 0.5), (1.0, 0, 0), [(x, 0.5, 0.5) for x in returns], ground or [False] * len(returns))])
    return {name: [round(float(got[(i, 0, 0)][COUNTS.index(name)]), 9) for i in range(4)] for name in COUNTS}


def test_hand_worked_rays():
    one = along([1.5])
    assert one["hits"] == [0, 1, 0, 0] and one["miss"] == [1, 0, 0, 0] and one["occl"] == [0, 0, 1, 1]
    two = along([1.5, 2.5])
    assert two["hits"] == [0, 0.5, 0.5, 0] and two["miss"] == [1, 0.5, 0, 0] and two["occl"] == [0, 0.5, 0.5, 1]
    none = along([])
    assert none["miss"] == [1] * 4 and none["occl"] == [0] * 4 and none["pmiss"] == [0] * 4
    floor = along([1.5], [True])
    assert floor["hits"] == [0] * 4 and floor["occl"][1] == 1


def test_against_stepwise():
    rng = np.random.default_rng(11)
    rays = []
    for i in range(400):
        o, d = rng.uniform(-3, 6, 3), rng.normal(size=3)
        if i % 5 == 0:
            d[rng.integers(3)] = 0
        d /= np.linalg.norm(d)
        t = np.sort(rng.uniform(0, 9, rng.integers(0, 4)))
        rays.append((tuple(o), tuple(d), [tuple(o + x * d) for x in t], list(rng.random(len(t)) < 0.3)))
    want = {}
    for r in rays:
        for k, s in stepwise(*r, BOX).items():
            want[k] = want.get(k, np.zeros(6)) + [s[c] for c in COUNTS]
    got = run(rays)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k
    beams = sum(s[0] + s[1] + s[2] for s in got.values())
    assert beams > 0


def test_spark_traversal_is_the_kernel(spark):
    rng = np.random.default_rng(12)
    rays = []
    for i in range(60):
        o, d = rng.uniform(-1, 4, 3), rng.normal(size=3)
        rays.append(("ab"[i % 2], *map(float, o), *map(float, d), [tuple(map(float, o + d)) + (False,)] * (i % 3)))
    df = spark.createDataFrame(rays, "scan_id string, x0 double, y0 double, z0 double, dx double, dy double, dz double, returns array<struct<x:double,y:double,z:double,ground:boolean>>").repartition(3)
    got = {(r.scan_id, r.vidx): r for r in voxels.traverse(df, BOX).collect()}
    want = {}
    for s in "ab":
        for k, v in run([(r[1:4], r[4:7], [p[:3] for p in r[7]], [False] * len(r[7])) for r in rays if r[0] == s]).items():
            want[(s, k[0] + 4 * k[1] + 12 * k[2])] = v
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose([got[k][c] for c in COUNTS], v)
    assert voxels.traverse(df.limit(0), BOX).count() == 0


def test_ray_box(spark):
    rows = [(-1.0, 1.0, 1.0, 1.0, 0.0, 0.0, True), (-1.0, 1.0, 1.0, -1.0, 0.0, 0.0, False), (-1.0, 9.0, 1.0, 1.0, 0.0, 0.0, False), (1.0, 1.0, 1.0, 0.0, 0.0, 1.0, True), (-1.0, -1.0, -1.0, 1.0, 1.0, 1.0, True)]
    d = spark.createDataFrame(rows, "ox double, oy double, oz double, dx double, dy double, dz double, want boolean")
    hit, lo, hi = voxels.ray_box([F.col("ox"), F.col("oy"), F.col("oz")], [F.col("dx"), F.col("dy"), F.col("dz")], BOX)
    assert d.where(hit != F.col("want")).count() == 0
    assert d.where("ox = -1 and want").select(lo.alias("lo")).first().lo == 1.0


def test_classes_and_ratios(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 5.0), (0.0, 0.0, 2.0), (0.0, 0.0, 0.0), (0.0, -1.0, 0.0)], "hits double, miss double, occl double")
    assert [r[0] for r in d.select(voxels.voxel_class()).collect()] == [5, 4, 3, 2, None]
    r = voxels.ratios(d.withColumns({"zeni": F.lit(3.0), "phit": F.lit(1.0), "pmiss": F.lit(2.0)})).collect()
    assert (r[0].pgap, r[0].vwts, r[2].pgap, r[2].vwts, r[2].zeni, r[3].zeni) == (0.0, 3.0, None, None, 1.5, None)


def test_linear_model(spark):
    rng = np.random.default_rng(5)
    zen, gap, w = rng.uniform(0.1, 1.3, 6), rng.uniform(0, 1, 6), rng.uniform(0, 2, 6)
    gap[0] = 0
    rows = [(0, 0, 0, float(a), float(b), float(c)) for a, b, c in zip(zen, gap, w)] + [(1, 0, 0, 0.5, 0.5, 1.0)] * 3 + [(2, 0, 0, 0.5, 0.5, 1.0)] * 2
    m = {r.x: r for r in voxels.linear_model(spark.createDataFrame(rows, "x int, y int, z int, zeni double, pgap double, vwts double")).collect()}
    t, k = np.abs(2 * np.tan(zen) / np.pi), -np.log(np.where(gap > 0, gap, 1e-5))
    a, b = np.linalg.lstsq(np.stack([np.ones(6), t], 1) * np.sqrt(w)[:, None], k * np.sqrt(w), rcond=None)[0]
    pv, ph = b, a
    if b < 0:
        pv, ph = 0.0, k.mean()
    if a < 0:
        pv, ph = (k / t).mean(), 0.0
    assert m[0].paiv == pytest.approx(pv) and m[0].paih == pytest.approx(ph) and m[0].nscans == 6 and 2 not in m
    x = abs(2 * math.tan(0.5) / math.pi)
    assert m[1].paiv == pytest.approx(x * math.log(2) / (1 + x * x)) and m[1].paih == pytest.approx(math.log(2) / (1 + x * x))


def test_cover_and_config(spark):
    d = spark.createDataFrame([(0, 0, 0, 0.2), (0, 0, 1, 0.3), (0, 0, 2, 0.5)], "x int, y int, z int, paiv double")
    assert [round(r.cover, 5) for r in voxels.cover_profile(d, 3).orderBy("z").collect()] == [0.39347, 0.25918, 0]
    assert Box.from_config(Box((0, 0, 0, 5, 4, 3), 0.5).config()).n == (10, 8, 6)

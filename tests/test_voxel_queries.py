"""The voxel model over the traversal of all pulses, by brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from test_voxels import stepwise

from gapfold.operators.voxels import COUNTS
from gapfold.plans import registry
from gapfold.plans import voxels as plan
from gapfold.plans.common import moved

DATA = "/root/testdata/sf0.001"
XYZ = ("x", "y", "z")


@pytest.fixture(scope="module")
def walked(spark):
    """Sums by (scan, voxel) of a walk of each pulse; pulses without a return;
    places of the returns."""
    at, places = defaultdict(list), set()
    for r in moved(spark, DATA).collect():
        at[(r.scan_id, r.scanline, r.scanline_idx)].append((r.target_index, r.x, r.y, r.z))
    sums, empty = {}, 0
    for p in plan._rays(spark, DATA).collect():
        back = [x[1:] for x in sorted(at.get((p.scan_id, p.scanline, p.scanline_idx), []))]
        empty += not back
        o, d = [p[f"beam_origin_{a}"] for a in XYZ], [p[f"beam_direction_{a}"] for a in XYZ]
        b = plan.COARSE.bounds
        places |= {(p.scan_id, *(math.floor((x[i] - b[i]) / plan.COARSE.size) for i in range(3))) for x in back}
        for k, s in stepwise(o, d, back, [False] * len(back), plan.COARSE).items():
            sums[(p.scan_id, *k)] = sums.get((p.scan_id, *k), np.zeros(6)) + [s[c] for c in COUNTS]
    return sums, empty, places


def rows(spark, name, keys):
    return {tuple(r[k] for k in keys): r for r in registry.queries()[name](spark, DATA).collect()}


def near(got, want):
    assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, abs=2e-6, rel=1e-6))


def test_scan_tables(spark, walked):
    sums, empty, places = walked
    assert empty > 0 and set(sums) - places
    stack, ratio, cls = (rows(spark, n, ("scan_id", *XYZ)) for n in ("voxel_stack", "voxel_ratios", "voxel_class"))
    low, high = plan._LAYERS
    assert ratio.keys() == cls.keys() == sums.keys() and stack.keys() == {k for k in sums if low <= k[3] <= high} and stack
    for k, (hits, miss, occl, zeni, phit, pmiss) in sums.items():
        for c, v in (("hits", hits), ("miss", miss), ("occl", occl)):
            if k in stack:
                near(stack[k][c], v)
        seen = hits + miss > 0
        near(ratio[k].vwts, phit + pmiss if seen else None)
        near(ratio[k].pgap, miss / (hits + miss) if seen else None)
        near(ratio[k].zeni, zeni / (hits + miss + occl))
        assert cls[k].vcls == (5 if hits else 4 if miss else 3)


def test_model(spark, walked):
    by = defaultdict(list)
    for (_, *k), s in walked[0].items():
        by[tuple(k)].append(s)
    occl, count = rows(spark, "voxel_occlusion", XYZ), rows(spark, "voxel_nscans", XYZ)
    model, cover = rows(spark, "voxel_linear", XYZ), rows(spark, "cover_profile", XYZ)
    assert occl.keys() == count.keys() == by.keys() and model.keys() == cover.keys()
    solved, paiv = 0, {}
    for k, scans in by.items():
        a = np.array(scans)
        near(occl[k].nbeam, a[:, :3].sum())
        near(occl[k].poccl, a[:, 2].sum() / a[:, :3].sum())
        a = a[a[:, 0] + a[:, 1] > 0]
        w = a[:, 4] + a[:, 5]
        assert count[k].nscans == (w > 0).sum()
        assert (k in model) == (len(a) >= 3)
        if k in model:
            assert model[k].nscans == (w > 0).sum()
            gap = a[:, 1] / (a[:, 0] + a[:, 1])
            t, y = np.abs(2 * np.tan(a[:, 3] / a[:, :3].sum(1)) / math.pi), -np.log(np.where(gap > 0, gap, 1e-5))
            m = np.stack([np.ones(len(t)), t], 1) * np.sqrt(w)[:, None]
            # a voxel with too little spread of weighted angles has no stable answer to compare
            if np.linalg.matrix_rank(m) == 2 and np.linalg.cond(m) < 1e3:
                h, v = np.linalg.lstsq(m, y * np.sqrt(w), rcond=None)[0]
                near(model[k].paiv, (y / t).mean() if h < 0 else max(v, 0.0))
                near(model[k].paih, 0.0 if h < 0 else y.mean() if v < 0 else h)
                solved += 1
            paiv[k] = model[k].paiv or 0.0
    assert solved > 0
    for x, y, z in cover:
        near(cover[(x, y, z)].cover, 1 - math.exp(-sum(v for (a, b, c), v in paiv.items() if (a, b) == (x, y) and z <= c < plan.COARSE.n[2] - 1)))

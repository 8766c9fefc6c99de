import numpy as np
from pyspark.sql import functions as F

from gapfold.operators import regrid
from gapfold.operators.regrid import leaf_grid, missing_slots, regular_grid


def pchip(t, v, x):
    """Monotone cubic through all knots, one at a time."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(len(t))
    if len(t) == 2:
        m[:] = d[0]
    else:
        for i in range(1, len(t) - 1):
            if d[i - 1] * d[i] > 0:
                w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

        def end(h0, h1, d0, d1):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.searchsorted(t, x) - 1
    u = (x - t[i]) / h[i]
    return v[i] * (2 * u**3 - 3 * u**2 + 1) + h[i] * m[i] * (u**3 - 2 * u**2 + u) + v[i + 1] * (3 * u**2 - 2 * u**3) + h[i] * m[i + 1] * (u**3 - u**2)


def test_against_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(np.arange(0, 4000, 1.7), 260, replace=False))
    t = t[(t < 900) | (t > 1200)]
    v = np.cumsum(rng.normal(size=len(t)))
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, v)], "s string, t double, v double")
    slot = (t // 10 * 10).astype(int)
    ks = np.unique(slot)
    kt, kv = np.array([t[slot == k].mean() for k in ks]), np.array([v[slot == k].mean() for k in ks])
    cuts = [0, *(np.flatnonzero(np.diff(ks) > 60) + 1), len(ks)]
    want = {}
    for a, b in zip(cuts, cuts[1:]):
        for k, x in zip(ks[a:b], kv[a:b]):
            want[k] = ("observed", x)
        for k in range(ks[a], ks[b - 1], 10):
            if k not in want:
                want[k] = ("filled", pchip(kt[a:b], kv[a:b], k + 5.0))
    for k in range(ks[0], ks[-1], 10):
        want.setdefault(k, ("gap", None))
    for shard in (50, 300, 10**6):
        monkeypatch.setattr(regrid, "SHARD_SECONDS", shard)
        got = {r.slot_epoch: (r.status, r.value) for r in regular_grid(df, "s", F.col("t"), F.col("v")).collect()}
        assert got.keys() == want.keys()
        for k, (status, x) in want.items():
            assert got[k][0] == status, k
            assert x is None and got[k][1] is None or abs(got[k][1] - x) < 1e-9, (shard, k, got[k], x)


SHOTS = "scan_id string, range1 double, intensity1 int, t string"


def shots(spark, rows):
    return spark.createDataFrame(rows, SHOTS).withColumn("datetime", F.col("t").cast("timestamp_ntz"))


def test_usable_readings(spark):
    df = shots(spark, [
        ("a", 5.0, 1, "1970-01-01 00:00:09.9"), ("a", 5.0, 1, "1970-01-01 00:00:09.9"), ("a", float("nan"), 9, "1970-01-01 00:00:10"), ("a", -1.0, 9, "1970-01-01 00:00:20"), ("a", 120.5, 9, "1970-01-01 00:00:30"),
        ("a", 5.0, 0, "1970-01-01 00:00:40"), ("a", None, 9, "1970-01-01 00:00:41"), ("a", 5.0, None, "1970-01-01 00:00:42"), ("a", 120.0, 2, "1970-01-01 00:00:50"), ("a", 7.0, 2, "1970-01-01 00:01:00"),
        ("a", 5.0, 9, None), (None, 5.0, 9, "1970-01-01 00:00:00"), ("b", 5.0, 9, "1969-12-31 23:59:55")])
    assert sorted(map(tuple, missing_slots(df).collect())) == [("a", s) for s in (10, 20, 30, 40)]
    clash = df.selectExpr("*", "1 as slot", "2 as k", "3 as shard", "4 as value", "'p' as p", "5 as n", "6 as v")
    rows = {(r.scan_id, r.slot_epoch): (r.n_readings, r.status) for r in leaf_grid(clash).collect()}
    assert rows[("a", 0)] == (2, "observed") and rows[("b", -10)] == (1, "observed") and len(rows) == 8
    assert leaf_grid(df.limit(0)).count() == 0


def test_gap_of_years(spark):
    df = shots(spark, [("a", 5.0, 1, "2020-01-01 00:00:00"), ("a", 5.0, 1, "2022-01-01 00:00:00")])
    g = leaf_grid(df)
    assert g.where("status = 'gap'").count() == 731 * 8640 - 1

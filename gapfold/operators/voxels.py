"""Voxel model: ray traversal, counts, ratios, classes, and the model over scans.

A ray crosses many voxels in order and carries state along, so the traversal is
a kernel over Arrow batches: all rays of a batch advance one voxel per step in
NumPy, and only the batch's sums per voxel leave the kernel. The sums then go
through one hash aggregate. Rays that miss the box are filtered before the
kernel by plain expressions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfold.functions import expr

COUNTS = ["hits", "miss", "occl", "zeni", "phit", "pmiss"]
#: Rays that advance together.
RAYS = 16_384


@dataclass(frozen=True)
class Box:
    """Bounds (xmin, ymin, zmin, xmax, ymax, zmax) and voxel size."""

    bounds: tuple[float, ...] = (-25, -25, -15, 25, 25, 45)
    size: float = 1.0

    @property
    def n(self) -> tuple[int, int, int]:
        return tuple(int((self.bounds[i + 3] - self.bounds[i]) // self.size) for i in range(3))  # type: ignore[return-value]

    @property
    def dim(self) -> tuple[float, float, float]:
        return tuple(k * self.size for k in self.n)  # type: ignore[return-value]

    def config(self, dtm: str | None = None, positions: dict | None = None, nodata: float = -9999) -> str:
        nx, ny, nz = self.n
        return json.dumps({"bounds": list(self.bounds), "resolution": self.size, "nx": nx, "ny": ny, "nz": nz, "nodata": nodata, "dtm": dtm, "positions": positions or {}}, indent=4)

    @staticmethod
    def from_config(text: str) -> "Box":
        c = json.loads(text)
        return Box(tuple(c["bounds"]), c["resolution"])


def ray_box(o: list[Column], d: list[Column], box: Box) -> tuple[Column, Column, Column]:
    """(hit, tmin, tmax) of the slab test; an axis without direction never ends
    the ray but must hold its origin. tmin and tmax are NULL for a miss."""
    big = F.lit(1e300)
    lows, highs = [], []
    for i in range(3):
        a, b = (F.lit(float(box.bounds[i])) - o[i]) / F.nullif(d[i], F.lit(0.0)), (F.lit(float(box.bounds[i + 3])) - o[i]) / F.nullif(d[i], F.lit(0.0))
        inside = (o[i] >= box.bounds[i]) & (o[i] <= box.bounds[i + 3])
        lows.append(F.when(d[i] == 0, F.when(inside, -big).otherwise(big)).otherwise(F.least(a, b)))
        highs.append(F.when(d[i] == 0, F.when(inside, big).otherwise(-big)).otherwise(F.greatest(a, b)))
    lo, hi = F.greatest(*lows), F.least(*highs)
    hit = (lo <= hi) & (hi >= 0)
    return hit, F.when(hit, lo), F.when(hit, hi)


def _slabs(o: np.ndarray, d: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.array(box.bounds[:3], float), np.array(box.bounds[3:], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (lo - o) / d, (hi - o) / d
    flat = d == 0
    inside = (o >= lo) & (o <= hi)
    near = np.where(flat, np.where(inside, -np.inf, np.inf), np.minimum(a, b)).max(1)
    far = np.where(flat, np.where(inside, np.inf, -np.inf), np.maximum(a, b)).min(1)
    return near, far


def walk(o: np.ndarray, d: np.ndarray, returns: np.ndarray, ground: np.ndarray, count: np.ndarray, box: Box, snap: float = 1e-12):
    """Traverse all rays in lock step.

    o, d: (n, 3) origins and directions. returns: (n, k, 3); ground: (n, k)
    bool; count: (n,). Yields per step (ray numbers, voxel numbers, sums in the
    order of COUNTS). On a tie the ray steps in z before y before x. A return's
    weight is 1/count; weight not yet met is `miss`, weight left behind is
    `occl`. The path length credited to a voxel is that up to the next exit.
    """
    nx, ny, nz = box.n
    n3, lo, dim = np.array([nx, ny, nz]), np.array(box.bounds[:3], float), np.array(box.dim, float)
    near, far = _slabs(o, d, box)
    alive = np.flatnonzero((near <= far) & (far >= 0))
    if not len(alive):
        return
    o, d, count = o[alive], d[alive], count[alive]
    t0 = np.maximum(0.0, near[alive])
    start = o + t0[:, None] * d
    cell = np.floor((start - lo) / dim * n3)
    cell = np.where(cell == n3, n3 - 1, cell).astype(np.int64)
    step = np.sign(d).astype(np.int64)
    edge = lo + (cell + (step > 0)) / n3 * dim
    with np.errstate(divide="ignore", invalid="ignore"):
        t_max = np.where(step == 0, np.inf, t0[:, None] + (edge - start) / d)
        t_delta = np.where(step == 0, np.inf, box.size / np.abs(d))
    theta = np.arccos(np.clip(d[:, 2] / np.sqrt((d * d).sum(1)), -1, 1))
    at = np.floor((returns[alive] - lo) / dim * n3)
    in_box = ((at >= 0) & (at < n3)).all(2)
    at = np.where(in_box[..., None], at, 0).astype(np.int64)
    target = np.where(in_box, at[..., 0] + nx * at[..., 1] + nx * ny * at[..., 2], -1)
    gnd, k = ground[alive], returns.shape[1]
    w = np.where(count > 0, 1.0 / np.maximum(count, 1), 0.0)
    wmiss, woccl, last = np.ones(len(alive)), np.zeros(len(alive)), np.zeros(len(alive), bool)
    left = t_max.min(1)
    while True:
        on = ((cell >= 0) & (cell < n3)).all(1)
        if not on.all():
            alive, cell, step, t_max, t_delta, theta, target, gnd, w, wmiss, woccl, last, left, count = (
                v[on] for v in (alive, cell, step, t_max, t_delta, theta, target, gnd, w, wmiss, woccl, last, left, count))
        if not len(alive):
            return
        voxel = cell[:, 0] + nx * cell[:, 1] + nx * ny * cell[:, 2]
        tx, ty, tz = t_max.T
        axis = np.where(tx < ty, np.where(tx < tz, 0, 2), np.where(ty < tz, 1, 2))
        rows = np.arange(len(alive))
        cell[rows, axis] += step[rows, axis]
        t_max[rows, axis] += t_delta[rows, axis]
        right = t_max.min(1)
        length = right - left
        hits, missed = np.zeros(len(alive)), np.zeros(len(alive), bool)
        for i in range(k):
            valid = i < count
            here = valid & (target[:, i] == voxel)
            hits += np.where(here & ~gnd[:, i], w, 0.0)
            woccl += np.where(here & gnd[:, i], w, 0.0)
            wmiss -= np.where(here, w, 0.0)
            other = valid & ~here
            woccl += np.where(other & last, w, 0.0)
            last = (last | here) & ~other
            missed |= other
        wmiss[np.abs(wmiss) < snap] = 0.0
        phit = np.where(w > 0, hits / np.where(w > 0, w, 1.0), 0.0) * length
        yield alive, voxel, (hits, wmiss.copy(), woccl.copy(), theta, phit, np.where(missed, length, 0.0))
        left = right


class _Sums:
    """Sums by key. What is added waits until there is much of it, then becomes
    one row per key, so no step of the rays is kept."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.rows, self.waiting = most, 0, []

    def add(self, keys: np.ndarray, values: tuple) -> None:
        self.waiting.append((keys, *values))
        self.rows += len(keys)
        if self.rows > self.most:
            found, sums = self.result()
            self.waiting, self.rows = [(found, *sums)], 0

    def result(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.waiting:
            return np.zeros(0, np.int64), []
        keys, *values = (np.concatenate(c) for c in zip(*self.waiting))
        found, at = np.unique(keys, return_inverse=True)
        return found, [np.bincount(at, v, len(found)) for v in values]


def _traverse_kernel(box: Box):
    nvox = int(np.prod(box.n))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, RAYS):
                b = whole.slice(at, RAYS)
                col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
                scan = pa.compute.dictionary_encode(col("scan_id"), null_encoding="encode")
                ids = scan.indices.to_numpy(zero_copy_only=False)
                o = np.stack([col(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "z0")], 1)
                d = np.stack([col(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "dz")], 1)
                ret = col("returns")
                count = np.diff(ret.offsets.to_numpy())
                items = ret.flatten()
                k = max(1, int(count.max(initial=0)))
                xyz, gnd = np.zeros((len(count), k, 3)), np.zeros((len(count), k), bool)
                ray = np.repeat(np.arange(len(count)), count)
                place = np.arange(len(ray)) - np.repeat(np.cumsum(count) - count, count)
                for i, c in enumerate("xyz"):
                    xyz[ray, place, i] = items.field(c).to_numpy(zero_copy_only=False)
                gnd[ray, place] = items.field("ground").to_numpy(zero_copy_only=False)
                total = _Sums()
                for rays, voxel, values in walk(o, d, xyz, gnd, count, box):
                    total.add(ids[rays].astype(np.int64) * nvox + voxel, values)
                found, sums = total.result()
                if len(found):
                    out = {"scan_id": scan.dictionary.take(pa.array(found // nvox)), "vidx": pa.array(found % nvox)}
                    yield pa.RecordBatch.from_pydict(out | {c: pa.array(s) for c, s in zip(COUNTS, sums)})

    return run


def rays(pulses: DataFrame, points: DataFrame, box: Box, ground: Column | None = None) -> DataFrame:
    """Pulses (project coordinates) that meet the box, with their returns."""
    from gapfold.operators.pulses import points_by_pulse

    p = points.withColumn("ground", F.coalesce(ground if ground is not None else F.lit(False), F.lit(False)))
    o, d = [F.col(f"beam_origin_{a}") for a in "xyz"], [F.col(f"beam_direction_{a}") for a in "xyz"]
    hit, _, _ = ray_box(o, d, box)
    some = (d[0] != 0) | (d[1] != 0) | (d[2] != 0)
    r = points_by_pulse(pulses.where(hit & some), p, ["x", "y", "z", "ground"])
    return r.select("scan_id", *[c.alias(f"{a}0") for a, c in zip("xyz", o)], *[c.alias(f"d{a}") for a, c in zip("xyz", d)], "returns")


def traverse(ray_table: DataFrame, box: Box) -> DataFrame:
    """scan_id, vidx, hits, miss, occl, zeni, phit, pmiss."""
    schema = "scan_id string, vidx long, " + ", ".join(f"{c} double" for c in COUNTS)
    part = ray_table.mapInArrow(_traverse_kernel(box), schema)
    return part.groupBy("scan_id", "vidx").agg(*[F.sum(c).alias(c) for c in COUNTS])


def with_xyz(v: DataFrame, box: Box) -> DataFrame:
    nx, ny, _ = box.n
    return v.withColumns({"x": (F.col("vidx") % nx).cast("int"), "y": F.expr(f"cast((vidx div {nx}) % {ny} as int)"), "z": F.expr(f"cast(vidx div {nx * ny} as int)")})


def ratios(v: DataFrame) -> DataFrame:
    """vwts, pgap and zeni from the sums; NULL where nothing was seen."""
    shots = F.col("hits") + F.col("miss")
    beams = shots + F.col("occl")
    return v.withColumns({
        "vwts": F.when(shots > 0, F.col("phit") + F.col("pmiss")),
        "pgap": F.when(shots > 0, F.col("miss") / shots),
        "zeni": F.when(beams > 0, F.col("zeni") / beams)})


def voxel_class() -> Column:
    """5 observed, 4 empty, 3 hidden, 2 unobserved, else NULL."""
    h, m, o = F.col("hits"), F.col("miss"), F.col("occl")
    return (F.when((h > 0) & (m >= 0) & (o >= 0), 5).when((h == 0) & (m > 0) & (o >= 0), 4)
            .when((h == 0) & (m == 0) & (o > 0), 3).when((h == 0) & (m == 0) & (o == 0), 2))


def voxelize(pulses: DataFrame, points: DataFrame, box: Box, ground: Column | None = None) -> DataFrame:
    """A voxel table per scan: x, y, z, sums, ratios and class."""
    sums = with_xyz(traverse(rays(pulses, points, box, ground), box), box)
    return ratios(sums.withColumn("vcls", voxel_class()))


def linear_model(v: DataFrame, min_n: int = 3, weights: bool = True, legacy: bool = False) -> DataFrame:
    """x, y, z, paiv, paih, nscans: weighted least squares of -ln(pgap) on
    |2 tan(zenith)/pi| over the scans of each voxel with at least min_n of them.
    Scans of one angle only take the least-norm solution. legacy=True swaps the
    two results."""
    d = v.where("zeni is not null and pgap is not null and vwts is not null").select(
        "x", "y", "z", (F.col("vwts") if weights else F.lit(1.0)).alias("w"), "vwts", F.abs(2 * F.tan("zeni") / math.pi).alias("t"), (-expr.guarded_ln(F.col("pgap"))).alias("k"))
    s = d.groupBy("x", "y", "z").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("t")).alias("st"), F.sum(F.col("w") * F.col("k")).alias("sk"),
        F.sum(F.col("w") * F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("w") * F.col("t") * F.col("k")).alias("stk"),
        F.avg("k").alias("mk"), F.avg(F.col("k") / F.nullif("t", F.lit(0.0))).alias("mkt"), F.count_if(F.col("vwts") > 0).alias("nscans")).where(F.col("n") >= min_n)
    det = F.col("sw") * F.col("stt") - F.col("st") * F.col("st")
    flat = F.abs(det) <= 1e-12 * F.col("sw") * F.col("stt")
    mean_t, mean_k = F.col("st") / F.nullif("sw", F.lit(0.0)), F.col("sk") / F.nullif("sw", F.lit(0.0))
    one = mean_k / (1 + mean_t * mean_t)
    slope = F.when(flat, F.coalesce(one * mean_t, F.lit(0.0))).otherwise((F.col("sw") * F.col("stk") - F.col("st") * F.col("sk")) / F.nullif(det, F.lit(0.0)))
    s = s.withColumn("b", slope).withColumn("a", F.when(flat, F.coalesce(one, F.lit(0.0))).otherwise(mean_k - F.col("b") * mean_t))
    first, second = ("a", "b") if legacy else ("b", "a")
    pv = F.when(F.col(second) < 0, F.col("mkt")).when(F.col(first) < 0, 0.0).otherwise(F.col(first))
    ph = F.when(F.col(second) < 0, 0.0).when(F.col(first) < 0, F.col("mk")).otherwise(F.col(second))
    return s.select("x", "y", "z", pv.alias("paiv"), ph.alias("paih"), "nscans")


def occlusion(v: DataFrame) -> DataFrame:
    """x, y, z, poccl, nbeam over all scans; poccl NULL without a beam."""
    s = v.groupBy("x", "y", "z").agg(*[F.sum(c).alias(c) for c in ("occl", "miss", "hits")])
    n = F.col("occl") + F.col("miss") + F.col("hits")
    return s.select("x", "y", "z", F.when(n > 0, F.col("occl") / n).alias("poccl"), n.alias("nbeam"))


def scan_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("x", "y", "z").agg(F.count_if(F.col("vwts") > 0).alias("nscans"))


def cover_profile(model: DataFrame, nz: int) -> DataFrame:
    """Canopy cover from the top down: 1 - exp(-sum of paiv above, own layer
    included); the top layer counts 0. Columns are a few dozen voxels high."""
    from pyspark.sql import Window

    down = Window.partitionBy("x", "y").orderBy(F.col("z").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("z") < nz - 1, F.coalesce("paiv", F.lit(0.0))).otherwise(0.0)
    return model.select("x", "y", "z", (1 - F.exp(-F.sum(own).over(down))).alias("cover"))


def dtm_cell(x: Column, y: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    return expr.bin_index(ymax - y, res), expr.bin_index(x - xmin, res)


def with_ground(points: DataFrame, dtm: DataFrame, xmin: float, ymax: float, res: float, threshold: float = 0.25) -> DataFrame:
    """points plus `dtm` (NULL outside the raster) and `ground`: z below the
    terrain plus the threshold. dtm: row, col, val."""
    r, c = dtm_cell(F.col("x"), F.col("y"), xmin, ymax, res)
    side = dtm.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("val").alias("dtm"))
    p = points.withColumns({"__r": r, "__c": c}).join(side, ["__r", "__c"], "left").drop("__r", "__c")
    return p.withColumn("ground", F.coalesce(F.col("z") < F.col("dtm") + threshold, F.lit(False)))


def ground_voxels(spark, dtm: DataFrame, box: Box, xmin: float, ymax: float, res: float) -> DataFrame:
    """x, y, z of the voxels whose centre lies below the terrain; rows count
    from the north."""
    nx, ny, nz = box.n
    b, s = box.bounds, box.size
    xy = spark.range(nx).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    xc, yc = b[0] + F.col("x") * s + s / 2, b[4] - (F.col("y") * s + s / 2)
    r, c = dtm_cell(xc, yc, xmin, ymax, res)
    j = xy.withColumns({"row": r, "col": c}).join(dtm.select("row", "col", "val"), ["row", "col"])
    return j.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(nz - 1)))).where(b[2] + F.col("z") * s + s / 2 < F.col("val")).select("x", "y", "z")



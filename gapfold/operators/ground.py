"""Ground: lowest return per cell, robust plane, plane surface."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfold.functions import expr

#: Cells that may come to the driver for a plane fit.
MAX_CELLS = 1_000_000


def min_z_grid(points: DataFrame, extent: float, res: float, origin: tuple[float, float] = (0.0, 0.0), order: tuple[str, ...] = ("scan_id", "riegl_id")) -> DataFrame:
    """y, x (cell), and the whole lowest return of the cell: px, py, pz, r.
    Ties go to the first in `order`. One aggregate that combines before its
    shuffle."""
    n = int(extent // res) + 1
    xi = expr.bin_index(F.col("x") - (origin[0] - extent / 2), res)
    yi = expr.bin_index((origin[1] + extent / 2) - F.col("y"), res)
    row = F.struct(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("range").alias("r"))
    d = points.select(yi.alias("yi"), xi.alias("xi"), row.alias("row"), F.struct("z", *order).alias("ord")).where(
        F.col("xi").between(0, n - 1) & F.col("yi").between(0, n - 1) & F.col("ord.z").isNotNull() & ~F.isnan("ord.z"))
    return d.groupBy("yi", "xi").agg(F.min_by("row", "ord").alias("p")).select(F.col("yi").alias("y"), F.col("xi").alias("x"), "p.*")


@dataclass(frozen=True)
class Plane:
    """z = a + b*x + c*y; slope and aspect in degrees."""

    a: float
    b: float
    c: float

    @property
    def slope(self) -> float:
        return math.degrees(math.atan(math.hypot(self.b, self.c)))

    @property
    def aspect(self) -> float:
        return math.degrees(math.atan(self.b / self.c)) if self.c else math.copysign(90.0, self.b)

    def report(self) -> str:
        return f"Parameters:\n{self.a} {self.b} {self.c}\nSlope:\n{self.slope}\nAspect:\n{self.aspect}\n"


def plane_fit(x, y, z, w=None, tuning: float = 1.345, rounds: int = 50, tol: float = 1e-8) -> Plane:
    """Huber M-estimate by iteratively reweighted least squares; the prior
    weight multiplies both sides. Scale: median |residual| / 0.6745, estimated
    anew each round."""
    x, y, z = (np.asarray(v, float) for v in (x, y, z))
    w = np.ones_like(z) if w is None else np.asarray(w, float)
    if len(z) < 3:
        raise ValueError("a plane needs three cells")
    a, t = np.stack([w, x * w, y * w], 1), w * z
    beta = np.linalg.lstsq(a, t, rcond=None)[0]
    old = np.inf
    for _ in range(rounds):
        res = t - a @ beta
        scale = np.median(np.abs(res)) / 0.6744897501960817
        if scale == 0:
            break
        u = np.abs(res) / scale
        k = np.sqrt(np.where(u <= tuning, 1.0, tuning / np.maximum(u, tuning)))
        beta = np.linalg.lstsq(a * k[:, None], t * k, rcond=None)[0]
        dev = float(np.where(u <= tuning, u * u / 2, tuning * u - tuning * tuning / 2).sum())
        if abs(old - dev) < tol:
            break
        old = dev
    return Plane(*map(float, beta))


def ground_plane(points: DataFrame, extent: float = 60, res: float = 10, origin: tuple[float, float] = (0.0, 0.0)) -> Plane:
    """Plane through the lowest returns, weighted by 1/range. One row per
    occupied cell comes to the driver; more than MAX_CELLS are refused."""
    rows = min_z_grid(points, extent, res, origin).where("r > 0").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} occupied cells")
    rows.sort(key=lambda r: (r.y, r.x))
    return plane_fit([r.px for r in rows], [r.py for r in rows], [r.pz for r in rows], [1 / r.r for r in rows])


def ground_plane_auto(points: DataFrame, res: float = 10) -> Plane:
    """The same with origin and extent from the data."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    extent = max(b.x1 - b.x0, b.y1 - b.y0)
    return ground_plane(points, extent, res, (b.x0 + extent / 2, b.y1 - extent / 2))


def plane_frame(spark, p: Plane) -> DataFrame:
    return spark.createDataFrame([(p.a, p.b, p.c, p.slope, p.aspect)], "intercept double, bx double, cy double, slope double, aspect double")


def plane_surface(spark, plane: tuple[float, float, float], x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The plane on a lattice of whole metres."""
    xs = spark.range(x0, x1 + 1).select(F.col("id").cast("double").alias("x"))
    ys = xs.withColumn("y", F.explode(F.sequence(F.lit(y0), F.lit(y1)))).withColumn("y", F.col("y").cast("double"))
    return ys.withColumn("z", plane[0] + plane[1] * F.col("x") + plane[2] * F.col("y"))

"""Grids as sparse long tables (z, y, x, value, cnt): a missing row is nodata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfold.functions import expr

METHODS = {"MEAN": F.avg, "SUM": F.sum, "MAX": F.max, "MIN": F.min}


def aggregate(df: DataFrame, value: Column, x: Column, y: Column, z: Column | int = 0, shape: tuple[int, int, int] | None = None, method: str = "MEAN") -> DataFrame:
    """Values by cell; NULL and NaN values and cells outside `shape` (layers,
    rows, columns) are left out. One hash aggregate that combines before its
    shuffle: a cell that gets a third of all values costs one row per task."""
    if method not in METHODS:
        raise ValueError(f"no grid method {method!r}")
    d = df.select(z.cast("int").alias("z") if isinstance(z, Column) else F.lit(z).alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), expr.clean(value.cast("double")).alias("v"))
    d = d.where("v is not null and x >= 0 and y >= 0 and z >= 0")
    if shape:
        d = d.where((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))
    return d.groupBy("z", "y", "x").agg(METHODS[method]("v").alias("value"), F.count("v").alias("cnt"))


def cartesian(points: DataFrame, res: float, value: Column, method: str = "MAX", extent: tuple[float, float] = (50, 50), ulc: tuple[float, float] = (-25, 25)) -> DataFrame:
    """Grid over x and y from the upper left corner; any number of scans."""
    cols, rows = int(extent[0] // res + 1), int(extent[1] // res + 1)
    return aggregate(points, value, expr.bin_index(F.col("x") - ulc[0], res), expr.bin_index(ulc[1] - F.col("y"), res), 0, (1, rows, cols), method)


def spherical_shape(resolution: float) -> tuple[float, int, int]:
    res = math.radians(resolution)
    return res, int(math.pi // res + 1), int(2 * math.pi // res + 1)


def spherical(df: DataFrame, resolution: float, value: Column, method: str = "MEAN", band: Column | None = None, bands: int = 1) -> DataFrame:
    """Grid over azimuth and zenith (degrees of resolution); `band` numbers
    range layers."""
    res, rows, cols = spherical_shape(resolution)
    return aggregate(df, value, expr.bin_index(F.col("azimuth"), res), expr.bin_index(F.col("zenith"), res), 0 if band is None else band, (bands, rows, cols), method)


def spherical_ranges(df: DataFrame, resolution: float, range_resolution: float, max_range: float, value: Column, method: str = "MEAN") -> DataFrame:
    return spherical(df, resolution, value, method, expr.bin_index(F.col("range"), range_resolution), int(max_range // range_resolution + 1))


def scan_grid(points: DataFrame, attribute: str, order: list[str]) -> DataFrame:
    """Scan geometry: scanline across, index down, a layer per return. Where a
    cell gets several values the last in `order` stays."""
    at = F.struct(*order)
    return points.where(expr.clean(F.col(attribute).cast("double")).isNotNull()).groupBy(
        "scan_id", (F.col("target_index") - 1).cast("int").alias("z"), F.col("scanline_idx").alias("y"), F.col("scanline").alias("x")).agg(
        F.max_by(attribute, at).alias("value"))


def overview(grid: DataFrame, factor: int) -> DataFrame:
    """The grid `factor` times coarser, mean of the cells with data."""
    return grid.groupBy("z", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).agg(F.avg("value").alias("value"))

"""Pulses and returns: cleaning, attaching, counting, re-indexing, transforms.

Returns hang on their pulse by (scan_id, scanline, scanline_idx). Duplicate
removal, re-indexing and attachment all partition by that key, so a chain of
them costs one shuffle per table; a pulse has a handful of returns, so no key
is ever hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfold.functions import expr, predicate

PULSE_KEY = ["scan_id", "scanline", "scanline_idx"]
ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]


def with_coordinates(points: DataFrame) -> DataFrame:
    """points without the rows whose x, y or z is NULL or NaN."""
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return points.where(ok)


def first_loaded(points: DataFrame) -> DataFrame:
    """One row per pulse key and riegl_id (see distinct_points)."""
    w = Window.partitionBy(*PULSE_KEY).orderBy("riegl_id", "loaded_at")
    return points.withColumn("__id", F.lag("riegl_id").over(w)).where("riegl_id is null or not (riegl_id <=> __id)").drop("__id")


def distinct_points(points: DataFrame) -> DataFrame:
    """One row per pulse key and riegl_id: the first loaded. Returns without a
    riegl_id can't be told to be copies and all stay. Rows without coordinates
    (NULL or NaN) are left out before the shuffle. The copies of a return agree in
    what was measured, so filters on that may come before."""
    return first_loaded(with_coordinates(points))


def distinct_pulses(pulses: DataFrame) -> DataFrame:
    """One row per pulse: repeated rows keep the smallest pulse_id and time."""
    w = Window.partitionBy(*PULSE_KEY).orderBy("pulse_id", "timestamp")
    return pulses.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reindex_targets(points: DataFrame, query: str | list[str] | None = None) -> DataFrame:
    """Filter, then number the returns of each pulse 1..n again, with n as their
    target_count. Order: target_index, then riegl_id."""
    w = Window.partitionBy(*PULSE_KEY)
    return predicate.where(points, query).withColumn("target_index", F.row_number().over(w.orderBy("target_index", "riegl_id"))).withColumn(
        "target_count", F.count(F.lit(1)).over(w).cast("int"))


def attach_pulses(points: DataFrame, pulses: DataFrame, columns: list[str]) -> DataFrame:
    """Each return with columns of its pulse, prefixed `pulse_`; returns without
    a pulse are left out."""
    side = pulses.select(*PULSE_KEY, *[F.col(c).alias(f"pulse_{c}") for c in columns])
    return points.join(side, PULSE_KEY)


def pulse_target_counts(pulses: DataFrame, points: DataFrame) -> DataFrame:
    """Each pulse with the number of returns it kept, 0 for a gap."""
    n = points.groupBy(*PULSE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return pulses.drop("target_count").join(n, PULSE_KEY, "left").withColumn("target_count", F.coalesce("n", F.lit(0)).cast("int")).drop("n")


def points_by_pulse(pulses: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Each pulse with its returns as an array of structs in target order; a
    pulse has at most a few returns. A gap has an empty array."""
    item = F.struct(F.col("target_index").cast("int").alias("target_index"), *columns)
    arr = points.groupBy(*PULSE_KEY).agg(F.array_sort(F.collect_list(item)).alias("returns"))
    return pulses.join(arr, PULSE_KEY, "left").withColumn("returns", F.coalesce("returns", F.array().cast(arr.schema["returns"].dataType)))


def transformed(points: DataFrame, scans: DataFrame, translate: bool = True, position: bool = False) -> DataFrame:
    """Returns in project coordinates: x, y, z rotated by their scan's matrix
    and moved by its position; zenith and azimuth from the rotated, unmoved
    coordinates. position=True keeps the scan's tx, ty, tz. The scans are a small
    dimension the engine broadcasts if they are small enough."""
    side = scans.select("scan_id", *ROTATION, "tx", "ty", "tz")
    x, y, z = expr.rotate(F.col("x"), F.col("y"), F.col("z"))
    j = points.join(side, "scan_id").withColumns({"__x": x, "__y": y, "__z": z})
    rx, ry, rz = F.col("__x"), F.col("__y"), F.col("__z")
    out = {"zenith": expr.zenith_of(rx, ry, rz), "azimuth": expr.azimuth_of(rx, ry)}
    out |= {c: v + F.col(f"t{c}") if translate else v for c, v in (("x", rx), ("y", ry), ("z", rz))}
    return j.withColumns(out).drop("__x", "__y", "__z", *ROTATION, *([] if position else ["tx", "ty", "tz"]))


def transformed_pulses(pulses: DataFrame, scans: DataFrame) -> DataFrame:
    """Pulses with origin and direction in project coordinates and the angles of
    the rotated direction."""
    side = scans.select("scan_id", *ROTATION, "tx", "ty", "tz")
    d = expr.rotate(*[F.col(f"beam_direction_{a}") for a in "xyz"])
    o = expr.rotate(*[F.col(f"beam_origin_{a}") for a in "xyz"])
    cols = {f"beam_direction_{a}": d[i] for i, a in enumerate("xyz")} | {f"beam_origin_{a}": o[i] + F.col(f"t{a}") for i, a in enumerate("xyz")}
    out = pulses.join(side, "scan_id").withColumns(cols)
    dx, dy, dz = (F.col(f"beam_direction_{a}") for a in "xyz")
    return out.withColumns({"zenith": expr.zenith_of(dx, dy, dz), "azimuth": expr.azimuth_of(dx, dy)}).drop(*ROTATION, "tx", "ty", "tz")


def scan_stats(points: DataFrame) -> DataFrame:
    """Largest scanline, index, range and target count of each scan."""
    return points.groupBy("scan_id").agg(
        F.max("scanline").alias("max_scanline"), F.max("scanline_idx").alias("max_scanline_idx"), F.max(expr.clean(F.col("range"))).alias("max_range"),
        F.max("target_count").alias("max_target_count"), F.count(F.lit(1)).alias("n_points"))


def height_above_plane(plane: tuple[float, float, float], x: str = "x", y: str = "y", z: str = "z") -> Column:
    """z above the plane a + b*x + c*y."""
    a, b, c = plane
    return F.col(z) - (b * F.col(x) + c * F.col(y) + a)


def height_above_sensor_ground(tz: Column, sensor_height: float | None, legacy: bool = False) -> Column:
    """Height where no plane is known: the ground lies sensor_height below the
    scanner. legacy=True adds the offset instead of subtracting it."""
    offset = tz - F.lit(sensor_height or 0.0)
    return F.col("z") + offset if legacy else F.col("z") - offset

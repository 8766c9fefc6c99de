"""LEAF shots: invalid readings, angles, heights, times, returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfold.functions import expr

#: Shots of a scan whose times are summed in one task.
SHARD_SHOTS = 65_536


def distinct_shots(shots: DataFrame) -> DataFrame:
    """One row per (scan_id, seq): the first loaded; of rows loaded at one time
    the first by their values, so that every run gives the same."""
    rest = [c for c in shots.columns if c not in ("scan_id", "seq", "loaded_at")]
    w = Window.partitionBy("scan_id", "seq").orderBy("loaded_at", *rest)
    return shots.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def invalidated(shots: DataFrame, max_range: float = 120.0) -> DataFrame:
    """-1 and NaN become NULL; a range beyond max_range or of intensity <= 0 too.
    A NULL intensity2 (older firmware) judges nothing."""
    value = lambda c: F.nullif(expr.clean(F.col(c)), F.lit(-1.0))
    r = {}
    for n in (1, 2):
        bad = (value(f"range{n}") > max_range) | F.coalesce(F.col(f"intensity{n}") <= 0, F.lit(False))
        r[f"range{n}"] = F.when(~bad, value(f"range{n}"))
    return shots.withColumns(r | {c: value(c) for c in ("scan_encoder", "rotary_encoder", "sample_time")})


def target_count(legacy: bool = False) -> Column:
    """Valid returns of a shot; legacy=True adds the second instead of
    subtracting it, as one old reader does."""
    a, b = F.col("range1").isNull().cast("int"), F.col("range2").isNull().cast("int")
    return 2 - a + b if legacy else 2 - a - b


def with_steps(shots: DataFrame, source: DataFrame | None = None, new: float = 25600.0, old: float = 10000.0) -> DataFrame:
    """shots plus `nsteps`, the encoder steps of a turn: scans of newer firmware
    have a second intensity. source: the raw table, to find that without
    repeating the work done on shots."""
    steps = (shots if source is None else source).groupBy("scan_id").agg(F.when(F.max(F.col("intensity2").isNotNull()), new).otherwise(old).alias("nsteps"))
    return shots.join(steps, "scan_id")


def scan_type(scan_id: Column) -> Column:
    return F.regexp_extract(scan_id, r"^\w{8}_\d{4}_(hemi|hinge|ground)_", 1)


def scan_time(scan_id: Column) -> Column:
    """UTC time in the scan's name, NULL if there is none."""
    t = F.regexp_extract(scan_id, r"_(\d{8}-\d{6})Z_", 1)
    return F.try_to_timestamp(F.nullif(t, F.lit("")), F.lit("yyyyMMdd-HHmmss"))


def angles(shots: DataFrame, nsteps: Column | float = 25600.0, zenith_offset: float = 0.0, tilt: tuple[float, float, float] | None = None) -> DataFrame:
    """zenith and azimuth from the encoders: offsets and tilt first, the half
    turn of hemi scans, one wrap into [0, 2 pi], zenith last."""
    steps = nsteps if isinstance(nsteps, Column) else F.lit(float(nsteps))
    zen = F.col("scan_encoder") / steps * expr.TWO_PI + zenith_offset
    azi = F.col("rotary_encoder") / 2e4 * expr.TWO_PI
    if tilt:
        x, y, z = (t / 1024 for t in tilt)
        zen = zen + math.acos(z / math.sqrt(x * x + y * y + z * z))
        azi = azi + math.atan2(x, y) + (expr.TWO_PI if x < 0 else 0.0)
    d = shots.withColumns({"__z": zen, "__a": azi})
    d = d.withColumn("__a", F.when((scan_type(F.col("scan_id")) == "hemi") & (F.col("__z") < math.pi), F.col("__a") + math.pi).otherwise(F.col("__a")))
    d = d.withColumn("__a", F.when(F.col("__a") > expr.TWO_PI, F.col("__a") - expr.TWO_PI).otherwise(F.col("__a")))
    d = d.withColumn("__a", F.when(F.col("__a") < 0, F.col("__a") + expr.TWO_PI).otherwise(F.col("__a")))
    return d.withColumns({"zenith": F.abs(F.col("__z") - math.pi), "azimuth": F.col("__a")}).drop("__z", "__a")


def heights(shots: DataFrame, sensor_height: float | None = None) -> DataFrame:
    """x, y, z of both returns; with a sensor height (0 counts) also h1 and h2."""
    cols = {}
    for n in (1, 2):
        x, y, z = expr.rza_to_xyz(F.col(f"range{n}"), F.col("zenith"), F.col("azimuth"))
        cols |= {f"x{n}": x, f"y{n}": y, f"z{n}": z}
        if sensor_height is not None:
            cols[f"h{n}"] = z + sensor_height
    return shots.withColumns(cols)


def row_times(shots: DataFrame) -> DataFrame:
    """shots plus `row_time`: the scan's start plus the sample times (ms) up to
    the row in order of seq. Scans are summed in shards of SHARD_SHOTS; only the
    shard totals meet in a window over the scan."""
    d = shots.withColumn("__s", F.floor(F.col("seq") / SHARD_SHOTS))
    up = Window.partitionBy("scan_id", "__s").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inner = d.withColumn("__c", F.sum(F.coalesce("sample_time", F.lit(0.0))).over(up))
    totals = d.groupBy("scan_id", "__s").agg(F.sum(F.coalesce("sample_time", F.lit(0.0))).alias("__t"))
    before = Window.partitionBy("scan_id").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("__b", F.coalesce(F.sum("__t").over(before), F.lit(0.0))).drop("__t")
    micros = F.unix_micros(scan_time(F.col("scan_id"))) + F.round((F.col("__b") + F.col("__c")) * 1000).cast("long")
    return inner.join(base, ["scan_id", "__s"]).withColumn("row_time", F.timestamp_micros(micros)).drop("__s", "__c", "__b")


def returns(shots: DataFrame) -> DataFrame:
    """One row per valid height: h1 and h2 as target_index 1 and 2."""
    return shots.withColumn("x", F.explode(F.array(F.struct(F.lit(1).alias("target_index"), F.col("h1").alias("height")), F.struct(F.lit(2).alias("target_index"), F.col("h2").alias("height"))))).select(
        "scan_id", "zenith", "azimuth", "target_count", "x.target_index", "x.height").where("height is not null and not isnan(height)")

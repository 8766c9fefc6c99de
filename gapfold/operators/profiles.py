"""Gap probability and plant profiles.

A profile cube is a sparse table of weights by (zenith, azimuth, height) bin and
one of shots by (zenith, azimuth); both are hash aggregates over the facts. All
that follows works on at most zenith x azimuth x height bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfold.functions import expr
from gapfold.session import written

METHODS = ("WEIGHTED", "FIRST", "ALL", "FIRSTLAST")


@dataclass(frozen=True)
class Cube:
    """Bins of a profile; angles in degrees, heights in metres."""

    hres: float = 0.5
    zres: float = 5
    ares: float = 45
    min_z: float = 0
    max_z: float = 70
    min_h: float = 0
    max_h: float = 50

    @property
    def nh(self) -> int:
        return int((self.max_h - self.min_h) // self.hres)

    @property
    def nz(self) -> int:
        return int((self.max_z - self.min_z) // self.zres)

    @property
    def na(self) -> int:
        return int(360 // self.ares)

    def zenith(self, i: int) -> float:
        """Middle of a ring, radians."""
        return math.radians(self.min_z + i * self.zres + self.zres / 2)

    def angles(self) -> tuple[Column, Column]:
        z = expr.bin_index(F.col("zenith") - math.radians(self.min_z), math.radians(self.zres))
        a = expr.bin_index(F.col("azimuth"), math.radians(self.ares))
        return z.alias("zi"), a.alias("ai")

    def height(self, h: Column) -> Column:
        return expr.bin_index(h - self.min_h, self.hres).alias("hi")


def zenith_window(df: DataFrame, min_zenith: float, max_zenith: float, max_hr: float | None = None) -> DataFrame:
    """zenith in [min, max) degrees; with max_hr the horizontal range below it.
    NaN is above every number, so it is outside."""
    z = F.col("zenith")
    out = df.where((z >= math.radians(min_zenith)) & (z < math.radians(max_zenith)))
    return out if max_hr is None else out.where(F.col("range") * F.sin("zenith") < max_hr)


def binned(df: DataFrame, cube: Cube, height: str | None = None, max_hr: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """df plus zi, ai and, with a height column, hi; zi is NULL outside the
    cube's zenith window (and from max_hr of horizontal range on).

    Meant to stand before the windows over a pulse: the bins are then computed
    once per row, and three small numbers cross the shuffle in place of
    coordinates and angles. keep: the columns of df that are still wanted."""
    zi, ai = cube.angles()
    z = F.col("zenith")
    inside = (z >= math.radians(cube.min_z)) & (z < math.radians(cube.max_z))
    if max_hr is not None:
        inside = inside & (F.col("range") * F.sin("zenith") < max_hr)
    cols = [F.when(inside, zi).alias("zi"), ai.alias("ai")]
    if height:
        cols.append(cube.height(expr.clean(F.col(height))).alias("hi"))
    return df.select(*(keep if keep is not None else df.columns), *cols)


def target_weight(method: str) -> Column:
    if method == "WEIGHTED":
        return 1 / F.nullif(F.col("target_count").cast("double"), F.lit(0.0))
    if method == "FIRSTLAST":
        return F.lit(0.5)
    if method == "ALL":
        return F.lit(1.0)
    if method == "FIRST":
        return F.when(F.col("target_index") == 1, 1.0)
    raise ValueError(f"no target weighting {method!r}")


def targets(points: DataFrame, cube: Cube, method: str = "WEIGHTED", height: str = "height") -> DataFrame:
    """zi, ai, hi, w: summed weights of the returns in each bin. points may be
    binned already."""
    b = points if "hi" in points.columns else binned(points, cube, height)
    d = b.select("zi", "ai", "hi", target_weight(method).alias("w")).where("w is not null")
    inside = F.col("zi").between(0, cube.nz - 1) & F.col("ai").between(0, cube.na - 1) & F.col("hi").between(0, cube.nh - 1)
    return d.where(inside).groupBy("zi", "ai", "hi").agg(F.sum("w").alias("w"))


def shots(pulses: DataFrame, cube: Cube, method: str = "WEIGHTED") -> DataFrame:
    """zi, ai, n: shots (for ALL: their returns) in each bin. pulses may be
    binned already."""
    b = pulses if "zi" in pulses.columns else binned(pulses, cube)
    n = F.sum(F.col("target_count").cast("double")) if method == "ALL" else F.count(F.lit(1)).cast("double")
    inside = F.col("zi").between(0, cube.nz - 1) & F.col("ai").between(0, cube.na - 1)
    return b.select("zi", "ai", "target_count").where(inside).groupBy("zi", "ai").agg(n.alias("n"))


def leaf_cube(shot_table: DataFrame, cube: Cube, method: str = "FIRSTLAST") -> tuple[DataFrame, DataFrame]:
    """(targets, shots) of LEAF shots with heights h1 and h2, from one aggregate
    over one scan: each shot gives itself and its valid returns. The aggregate
    (bins of the cube) is written once for both."""
    zi, ai = cube.angles()
    n = F.col("target_count").cast("double") if method == "ALL" else F.lit(1.0)
    item = lambda hi, w: F.struct(hi.alias("hi"), w.alias("w"))
    at = [expr.bin_index(expr.clean(F.col(c)) - cube.min_h, cube.hres) for c in ("h1", "h2")]
    h = [F.when(c >= 0, c) for c in at]  # -1 stands for the shot itself
    w = {i: {"WEIGHTED": target_weight("WEIGHTED"), "FIRSTLAST": F.lit(0.5), "ALL": F.lit(1.0), "FIRST": F.lit(1.0 if i == 0 else None).cast("double")}[method] for i in (0, 1)}
    rows = shot_table.select(zi, ai, F.explode(F.array(item(F.lit(-1), n), item(h[0], w[0]), item(h[1], w[1]))).alias("x")).select("zi", "ai", "x.hi", "x.w")
    inside = F.col("zi").between(0, cube.nz - 1) & F.col("ai").between(0, cube.na - 1) & F.col("hi").between(-1, cube.nh - 1)
    sums = written(rows.where(inside & F.col("w").isNotNull()).groupBy("zi", "ai", "hi").agg(F.sum("w").alias("w")), "cube")
    return sums.where("hi >= 0"), sums.where("hi = -1").select("zi", "ai", F.col("w").alias("n"))


def sum_by_index(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def cover(tgt: DataFrame, sht: DataFrame, cube: Cube) -> DataFrame:
    """zi, ai, hi, cover: returns up to a height over shots, for every height of
    every bin that was shot at."""
    dense = sht.where("n > 0").withColumn("hi", F.explode(F.sequence(F.lit(0), F.lit(cube.nh - 1))))
    up = Window.partitionBy("zi", "ai").orderBy("hi").rowsBetween(Window.unboundedPreceding, 0)
    return dense.join(tgt, ["zi", "ai", "hi"], "left").select("zi", "ai", "hi", (F.sum(F.coalesce("w", F.lit(0.0))).over(up) / F.col("n")).alias("cover"))


def azimuth_bins(cube: Cube, min_azimuth: float = 0, max_azimuth: float = 360, invert: bool = False) -> list[int]:
    """Bins whose middle lies in [min - ares/2, max + ares/2)."""
    lo, hi = min_azimuth - cube.ares / 2, max_azimuth + cube.ares / 2
    inside = [lo <= i * cube.ares + cube.ares / 2 < hi for i in range(cube.na)]
    return [i for i, x in enumerate(inside) if x != invert]


def pgap(cov: DataFrame, cube: Cube, min_azimuth: float = 0, max_azimuth: float = 360, invert: bool = False) -> DataFrame:
    """zi, hi, pgap: mean over the azimuth bins that were shot at."""
    bins = azimuth_bins(cube, min_azimuth, max_azimuth, invert)
    return cov.where(F.col("ai").isin(bins)).groupBy("zi", "hi").agg((1 - F.avg("cover")).alias("pgap"))


def hinge_ring(cube: Cube) -> int:
    """The ring nearest the hinge angle atan(pi/2)."""
    return min(range(cube.nz), key=lambda i: abs(cube.zenith(i) - math.atan(math.pi / 2)))


def _heights(spark, cube: Cube) -> DataFrame:
    return spark.range(cube.nh).select(F.col("id").cast("int").alias("hi"))


def pai_hinge(gap: DataFrame, cube: Cube) -> DataFrame:
    """hi, pai: -1.1 ln(pgap) at the hinge ring."""
    ring = gap.where(F.col("zi") == hinge_ring(cube))
    return _heights(gap.sparkSession, cube).join(ring, "hi", "left").select("hi", (-1.1 * expr.guarded_ln(F.col("pgap"))).alias("pai"))


def pai_linear(gap: DataFrame, cube: Cube) -> DataFrame:
    """hi, pai, paiv, paih, mla: least squares of -ln(pgap) on |2 tan(zenith)/pi|
    over more than two rings; a negative slope or intercept falls back to the
    other term alone."""
    xs = F.element_at(F.array(*[F.lit(expr.leaf_angle_x(cube.zenith(i))) for i in range(cube.nz)]), F.col("zi") + 1)
    rings = gap.sparkSession.range(cube.nz).select(F.col("id").cast("int").alias("zi")).crossJoin(_heights(gap.sparkSession, cube))
    d = rings.join(gap, ["zi", "hi"], "left").select("hi", xs.alias("x"), (-expr.guarded_ln(F.col("pgap"))).alias("y"))
    fit = d.groupBy("hi").agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("my"), F.avg(F.col("y") / F.col("x")).alias("myx"), F.count("y").alias("n"))
    many = F.col("n") > 2
    paiv = F.when(~many, 0.0).when(F.col("a") < 0, F.col("myx")).when(F.col("b") < 0, 0.0).otherwise(F.col("b"))
    paih = F.when(~many, 0.0).when(F.col("a") < 0, 0.0).when(F.col("b") < 0, F.col("my")).otherwise(F.col("a"))
    return fit.select("hi", paiv.alias("paiv"), paih.alias("paih")).select(
        "hi", (F.col("paiv") + F.col("paih")).alias("pai"), "paiv", "paih", F.degrees(F.atan2("paiv", "paih")).alias("mla"))


def pai_weighted(gap: DataFrame, cube: Cube, total_pai: float | None = None) -> DataFrame:
    """hi, pai: solid-angle weighted share of each height in the total PAI
    (default: the greatest hinge PAI); rings with pgap(top) < 1 only."""
    if total_pai is None:
        gap = written(gap, "gap")
    top = gap.where(F.col("hi") == cube.nh - 1).where("pgap < 1").select("zi", expr.guarded_ln(F.col("pgap")).alias("den"))
    size = math.radians(cube.zres)
    w = F.element_at(F.array(*[F.lit(2 * math.pi * math.sin(cube.zenith(i)) * size) for i in range(cube.nz)]), F.col("zi") + 1)
    total = F.lit(total_pai) if total_pai is not None else F.col("total")
    parts = gap.join(top, "zi").withColumn("w", w).groupBy("hi").agg((F.sum(F.col("w") * expr.guarded_ln(F.col("pgap")) / F.col("den")) / F.sum("w")).alias("ratio"))
    most = pai_hinge(gap, cube).agg(F.max("pai").alias("total"))
    return _heights(gap.sparkSession, cube).join(parts, "hi", "left").crossJoin(most).select("hi", (F.coalesce("ratio", F.lit(0.0)) * total).alias("pai"))


def pavd(profile: DataFrame, hres: float, central: bool = True, order: str = "hi", value: str = "pai", by: list[str] | None = None) -> DataFrame:
    """profile plus `pavd`, its derivative along height: central differences,
    one-sided at the ends; or forward differences with 0 after the end."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    v = F.col(value)
    if not central:
        return profile.withColumn("pavd", (F.lead(value, 1, 0.0).over(w) - v) / hres)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return profile.withColumn("pavd", F.when(before.isNull(), (after - v) / hres).when(after.isNull(), (v - before) / hres).otherwise((after - before) / (2 * hres)))


def plant_profiles(gap: DataFrame, cube: Cube) -> DataFrame:
    """One row per height: Height, HingePAI, LinearPAI, LinearMLA, WeightedPAI
    and the PAVD of each. The gap table (rings x heights) feeds four models, so
    it is written once instead of read from the facts four times."""
    gap = written(gap, "gap")
    h = pavd(pai_hinge(gap, cube), cube.hres).select("hi", F.col("pai").alias("HingePAI"), F.col("pavd").alias("HingePAVD"))
    li = pavd(pai_linear(gap, cube), cube.hres).select("hi", F.col("pai").alias("LinearPAI"), F.col("mla").alias("LinearMLA"), F.col("pavd").alias("LinearPAVD"))
    w = pavd(pai_weighted(gap, cube), cube.hres).select("hi", F.col("pai").alias("WeightedPAI"), F.col("pavd").alias("WeightedPAVD"))
    return h.join(li, "hi").join(w, "hi").select(
        (F.col("hi") * cube.hres + cube.min_h).alias("Height"), "HingePAI", "LinearPAI", "LinearMLA", "WeightedPAI", "HingePAVD", "LinearPAVD", "WeightedPAVD")


def ring_name(cube: Cube, i: int) -> str:
    return f"Zenith{(cube.min_z + i * cube.zres + cube.zres / 2) * 10:04.0f}"


def pgap_wide(gap: DataFrame, cube: Cube) -> DataFrame:
    """One row per height, a column per ring."""
    cols = [F.max(F.when(F.col("zi") == i, F.col("pgap"))).alias(ring_name(cube, i)) for i in range(cube.nz)]
    return gap.groupBy("hi").agg(*cols).select((F.col("hi") * cube.hres + cube.min_h).alias("Height"), *[ring_name(cube, i) for i in range(cube.nz)])

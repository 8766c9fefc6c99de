"""Irregular readings onto a regular grid.

Usable readings are averaged per source and slot; each slot with readings is a
knot (mean time, mean value). Slots between two knots are filled by monotone
(shape-preserving) cubic interpolation inside a segment; a gap longer than
`max_gap` ends a segment, and its slots stay marked. Sources are cut into time
shards, so no task holds a whole source; each shard gets its neighbours' two
edge knots as a halo, which is all the cubic needs.

Defined results: readings without source, time or a usable value are left out;
repeated rows weigh in the mean only; a source with one knot gives one row; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time shard, and missing slots listed by one array at most.
SHARD_SECONDS = 6 * 3600
CHUNK_SLOTS = 4096


def usable(range1: Column, intensity1: Column, at: Column, max_range: float = 120.0) -> Column:
    """A LEAF reading that counts."""
    return at.isNotNull() & range1.isNotNull() & ~F.isnan(range1) & (range1 != -1.0) & (range1 <= max_range) & (intensity1 > 0)


def _step(a: dict, b: dict) -> Column:
    """Seconds from knot a to b. A knot's time is its slot and an offset in it,
    so the difference keeps its digits."""
    return b["slot"] - a["slot"] + (b["t"] - a["t"])


def _secant(a: dict, b: dict) -> Column:
    return (b["v"] - a["v"]) / _step(a, b)


def _inner_slope(p: dict, a: dict, b: dict) -> Column:
    """Weighted harmonic mean of the neighbouring secants, 0 at a turn."""
    h0, h1, d0, d1 = _step(p, a), _step(a, b), _secant(p, a), _secant(a, b)
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / F.nullif(d0, F.lit(0.0)) + w1 / F.nullif(d1, F.lit(0.0))))


def _end_slope(a: dict, b: dict, c: dict) -> Column:
    """One-sided three-point slope at a, kept monotone."""
    h0, h1, d0, d1 = F.abs(_step(a, b)), F.abs(_step(b, c)), _secant(a, b), _secant(b, c)
    d = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(d * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(d) > 3 * F.abs(d0)), 3 * d0).otherwise(d)


def _cubic(x: Column, p: dict, a: dict, b: dict, c: dict, far: int) -> Column:
    """Value x seconds after knot a, between a and b; p and c may be absent or lie
    beyond a long gap, then a or b is an end of the segment."""
    has_p = p["slot"].isNotNull() & (a["slot"] - p["slot"] <= far)
    has_c = c["slot"].isNotNull() & (c["slot"] - b["slot"] <= far)
    da = F.when(has_p, _inner_slope(p, a, b)).when(has_c, _end_slope(a, b, c)).otherwise(_secant(a, b))
    db = F.when(has_c, _inner_slope(a, b, c)).when(has_p, _end_slope(b, a, p)).otherwise(_secant(a, b))
    h = _step(a, b)
    u = x / h
    return (a["v"] * (2 * u * u * u - 3 * u * u + 1) + h * da * (u * u * u - 2 * u * u + u)
            + b["v"] * (3 * u * u - 2 * u * u * u) + h * db * (u * u * u - u * u))


def regular_grid(readings: DataFrame, source: str, at: Column, value: Column, step: int = 10, max_gap: int = 60) -> DataFrame:
    """One row per source and slot from its first to its last knot:
    source, slot_epoch, n_readings, value, status (`observed`, `filled`, `gap`).

    readings: usable ones only. at: seconds since 1970 as a double. Slots begin
    at whole multiples of `step`; a filled slot has the cubic at its middle.
    """
    slot = (F.floor(at / step) * step).cast("long")
    knots = readings.select(F.col(source), slot.alias("slot"), (at - slot).alias("t"), value.alias("v")).where(
        F.col(source).isNotNull() & F.col("slot").isNotNull()
    ).groupBy(source, "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("t"), F.avg("v").alias("v"))
    knots = knots.withColumn("shard", F.floor(F.col("slot") / SHARD_SECONDS)).withColumn("k", F.struct("slot", "t", "v", "n"))

    inside = Window.partitionBy(source, "shard").orderBy("slot")
    marked = knots.select(
        source, "shard", "slot", "k", F.lag("k").over(inside).alias("p"), F.lead("k", 1).over(inside).alias("b"), F.lead("k", 2).over(inside).alias("c"),
        F.row_number().over(inside).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(source, "shard")).alias("size"))
    edge = marked.where("i <= 2 or i > size - 1").groupBy(source, "shard").agg(
        F.array_sort(F.collect_list(F.when(F.col("i") <= 2, F.col("k")))).alias("heads"), F.max("k").alias("tail"))
    along = Window.partitionBy(source).orderBy("shard")
    none = F.array().cast("array<struct<slot:bigint,t:double,v:double,n:bigint>>")
    ahead = F.concat(F.coalesce(F.lead("heads", 1).over(along), none), F.coalesce(F.lead("heads", 2).over(along), none))
    halo = edge.select(source, "shard", F.lag("tail").over(along).alias("hp"), F.get(ahead, F.lit(0)).alias("h1"), F.get(ahead, F.lit(1)).alias("h2"))
    left = F.col("size") - F.col("i")
    four = marked.join(halo, [source, "shard"], "left").select(
        source, F.col("k").alias("a"), F.coalesce("p", "hp").alias("p"), F.coalesce("b", "h1").alias("b"),
        F.when(left >= 2, F.col("c")).when(left == 1, F.col("h1")).otherwise(F.col("h2")).alias("c"))

    flat = four.select(source, *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in "apbc" for x in ("slot", "t", "v")], F.col("a.n").alias("a_n"))
    chunk = step * CHUNK_SLOTS
    rows = flat.withColumn("last", F.coalesce(F.col("b_slot") - step, F.col("a_slot"))).withColumn(
        "from", F.explode(F.sequence(F.col("a_slot"), F.col("last"), F.lit(chunk)))).withColumn(
        "slot_epoch", F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + (chunk - step)), F.lit(step).cast("long"))))
    observed = F.col("slot_epoch") == F.col("a_slot")
    near = F.col("b_slot") - F.col("a_slot") <= max_gap
    knot = lambda k: {x: F.col(f"{k}_{x}") for x in ("slot", "t", "v")}
    cubic = _cubic(F.col("slot_epoch") - F.col("a_slot") + (step / 2 - F.col("a_t")), knot("p"), knot("a"), knot("b"), knot("c"), max_gap)
    return rows.select(
        source, "slot_epoch", F.when(observed, F.col("a_n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(observed, F.col("a_v")).when(near, cubic).alias("value"),
        F.when(observed, "observed").when(near, "filled").otherwise("gap").alias("status"))


def leaf_grid(shots: DataFrame, step: int = 10, max_gap: int = 60) -> DataFrame:
    """The readings range1 of LEAF scans on a regular grid."""
    ok = shots.where(usable(F.col("range1"), F.col("intensity1"), F.col("datetime")))
    micros = F.unix_micros(F.col("datetime").cast("timestamp"))
    return regular_grid(ok, "scan_id", micros / F.lit(1e6), F.col("range1"), step, max_gap)


def missing_slots(shots: DataFrame, step: int = 10) -> DataFrame:
    """Slots between the first and last usable reading that have none."""
    return leaf_grid(shots, step).where("status <> 'observed'").select("scan_id", "slot_epoch")

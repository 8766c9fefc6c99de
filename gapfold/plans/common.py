"""Shared pieces of the queries: cleaned inputs, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfold.operators import leaf, pulses
from gapfold.sources.tables import table


class Registry:
    """Queries by name, with their SQL where there is one."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded to six digits, without a negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def points(spark, d: str) -> DataFrame:
    return pulses.distinct_points(table(spark, d, "points_rdb"))


def shots(spark, d: str) -> DataFrame:
    return pulses.distinct_pulses(table(spark, d, "pulses"))


def moved(spark, d: str) -> DataFrame:
    return pulses.transformed(points(spark, d), table(spark, d, "scans"))


def leaf_shots(spark, d: str) -> DataFrame:
    """LEAF shots, once each, invalid readings NULL, with their encoder steps."""
    raw = table(spark, d, "leaf_shots")
    return leaf.with_steps(leaf.invalidated(leaf.distinct_shots(raw)), raw)


def leaf_geometry(spark, d: str, sensor_height: float = 1.5) -> DataFrame:
    s = leaf.angles(leaf_shots(spark, d), F.col("nsteps"))
    return leaf.heights(s.withColumn("target_count", leaf.target_count()), sensor_height)


def fd(a: str, b: float) -> str:
    """a // b as an int, in SQL."""
    m = f"(({a}) % {b!r}::double)"
    q = f"((({a}) - {m}) / {b!r}::double - case when {m} < 0 then 1.0::double else 0.0::double end)"
    return f"cast(case when {q} - floor({q}) > 0.5 then floor({q}) + 1 else floor({q}) end as int)"


KEY = "scan_id, scanline, scanline_idx"
PTS = f"""pts as (select * exclude (pid) from (select *, lag(riegl_id) over (partition by {KEY} order by riegl_id, loaded_at) as pid from points_rdb
    where x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)) where riegl_id is null or pid is distinct from riegl_id)"""
PUL = f"pul as (select * from pulses qualify row_number() over (partition by {KEY} order by pulse_id, timestamp) = 1)"
ROT = ", ".join(f"x * r0{j} + y * r1{j} + z * r2{j} as r{a}" for j, a in enumerate("xyz"))
ANGLES = f"""case when sqrt(rx * rx + ry * ry + rz * rz) > 0 then acos(least(greatest(rz / sqrt(rx * rx + ry * ry + rz * rz), -1.0::double), 1.0::double)) end as zenith,
    case when rx < 0 then atan2(rx, ry + 0.0) + {2 * math.pi!r}::double else atan2(rx + 0.0, ry + 0.0) end as azimuth"""


def moved_sql(source: str = "pts", name: str = "tp") -> str:
    return f"""{name} as (select * exclude (x, y, z, rx, ry, rz, tx, ty, tz), rx + tx as x, ry + ty as y, rz + tz as z, {ANGLES}
        from (select p.*, {ROT}, tx, ty, tz from {source} p join scans using (scan_id)))"""


MOVED = f"{PTS}, {moved_sql()}"
# pulses with the angles of their rotated direction, like the returns'
TURNED = f"""tu as (select * exclude (rx, ry, rz, zenith, azimuth), {ANGLES} from (select p.*, {", ".join(f"beam_direction_x * r0{j} + beam_direction_y * r1{j} + beam_direction_z * r2{j} as r{a}" for j, a in enumerate("xyz"))}
    from pul p join scans using (scan_id)))"""
LEAF = f"""one as (select * from leaf_shots qualify row_number() over (partition by scan_id, seq order by loaded_at, sample_count nulls first, scan_encoder nulls first) = 1),
    val as (select * exclude (scan_encoder, rotary_encoder, sample_time, range1, range2),
        {", ".join(f"case when not isnan({c}) and {c} <> -1 then {c} end as {c}" for c in ("scan_encoder", "rotary_encoder", "sample_time"))},
        {", ".join(f"case when not isnan(range{n}) and range{n} <> -1 and range{n} <= 120 and coalesce(intensity{n}, 1) > 0 then range{n} end as range{n}" for n in (1, 2))} from one),
    steps as (select scan_id, case when bool_or(intensity2 is not null) then 25600.0::double else 10000.0::double end as nsteps from val group by 1),
    ls as (select v.*, nsteps from val v join steps using (scan_id))"""
_T = f"{2 * math.pi!r}::double"
_P = f"{math.pi!r}::double"
LEAF_ANGLES = f"""a0 as (select *, scan_encoder / nsteps * {_T} as zz, rotary_encoder / 20000.0::double * {_T} as a_ from ls),
    a1 as (select *, case when regexp_extract(scan_id, '^\\w{{8}}_\\d{{4}}_(hemi|hinge|ground)_', 1) = 'hemi' and zz < {_P} then a_ + {_P} else a_ end as a2 from a0),
    a3 as (select *, case when a2 > {_T} then a2 - {_T} else a2 end as a4 from a1),
    la as (select * exclude (zz, a_, a2, a4), abs(zz - {_P}) as zenith, case when a4 < 0 then a4 + {_T} else a4 end as azimuth, 2 - (range1 is null)::int - (range2 is null)::int as target_count from a3)"""
LEAF_GEO = f"{LEAF}, {LEAF_ANGLES}, lg as (select *, " + ", ".join(
    f"range{n} * sin(zenith) * sin(azimuth) as x{n}, range{n} * sin(zenith) * cos(azimuth) as y{n}, range{n} * cos(zenith) as z{n}, range{n} * cos(zenith) + 1.5::double as h{n}" for n in (1, 2)) + " from la)"


def r6s(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 as {name}"

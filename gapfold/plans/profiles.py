"""Queries of gap probability and plant profiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gapfold.functions import expr, predicate
from gapfold.operators import profiles, pulses
from gapfold.operators.profiles import Cube
from gapfold.plans.common import KEY, LEAF_GEO, PTS, PUL, TURNED, Registry, fd, leaf_geometry, moved_sql, r6, r6s
from gapfold.session import fresh_path
from gapfold.sources import sinks
from gapfold.sources.tables import table

R = Registry()
CUBE = Cube(hres=0.5, zres=5, ares=90, min_z=35, max_z=70, min_h=0, max_h=50)
LEAF_CUBE = Cube(hres=0.5, zres=5, ares=360, min_z=55, max_z=60, min_h=0, max_h=50)
FILTER = "reflectance > -20"


RETURN = [*pulses.PULSE_KEY, "riegl_id", "loaded_at", "target_index"]
SHOT = [*pulses.PULSE_KEY, "pulse_id", "timestamp", "target_count"]


def _binned_returns(spark, d, height, max_hr=None):
    """Returns that pass the filter, once each, re-indexed within their pulse,
    with the bins of their rotated direction and height."""
    p = predicate.where(pulses.with_coordinates(table(spark, d, "points_rdb")), FILTER)
    p = pulses.transformed(p, table(spark, d, "scans"), position=True).withColumn("height", height)
    return pulses.reindex_targets(pulses.first_loaded(profiles.binned(p, CUBE, "height", max_hr, RETURN)))


def _points(spark, d):
    return _binned_returns(spark, d, pulses.height_above_plane((0.0, 0.0, 0.0)))


def _pulses(spark, d):
    """Pulses, once each, with the bins of their rotated direction: shots and
    returns stand in one frame."""
    p = pulses.transformed_pulses(table(spark, d, "pulses"), table(spark, d, "scans"))
    return pulses.distinct_pulses(profiles.binned(p, CUBE, keep=SHOT))


def _gap(spark, d, method="WEIGHTED", **azimuth):
    cov = profiles.cover(profiles.targets(_points(spark, d), CUBE, method), profiles.shots(_pulses(spark, d), CUBE, method), CUBE)
    return profiles.pgap(cov, CUBE, **azimuth)


def _rad(x: float) -> str:
    return f"{math.radians(x)!r}::double"


_FILTERED = f"""{PTS}, fp as (select * exclude (target_index, target_count), row_number() over (partition by {KEY} order by target_index, riegl_id) as target_index,
    count(*) over (partition by {KEY}) as target_count from pts where reflectance > -20 and not isnan(reflectance)), {moved_sql('fp')}, {PUL}, {TURNED}"""


def _cube(cube: Cube, source: str, height: str, window: bool = True) -> str:
    z, a, h = fd(f"zenith - {_rad(cube.min_z)}", math.radians(cube.zres)), fd("azimuth", math.radians(cube.ares)), fd(f"{height} - {cube.min_h}", cube.hres)
    return f"(select *, {z} as zi, {a} as ai, {h} as hi from {source} where zenith >= {_rad(cube.min_z)} and zenith < {_rad(cube.max_z)} and not isnan(zenith))"


_WEIGHT = {"WEIGHTED": "1.0::double / target_count", "FIRSTLAST": "0.5::double", "ALL": "1.0::double", "FIRST": "case when target_index = 1 then 1.0::double end"}


def _tgt(method: str, source: str = "tp", height: str = "z") -> str:
    return f"""tg as (select zi, ai, hi, sum(w) as w from (select zi, ai, hi, {_WEIGHT[method]} as w from {_cube(CUBE, source, height)}) where w is not null
        and zi between 0 and {CUBE.nz - 1} and ai between 0 and {CUBE.na - 1} and hi between 0 and {CUBE.nh - 1} group by all)"""


def _sht(method: str) -> str:
    n = "sum(target_count)::double" if method == "ALL" else "count(*)::double"
    return f"sh as (select zi, ai, {n} as n from {_cube(CUBE, 'tu', '0.0::double')} where zi between 0 and {CUBE.nz - 1} and ai between 0 and {CUBE.na - 1} group by all)"


def _cov(method: str = "WEIGHTED", source: str = "tp", height: str = "z", more: str = "") -> str:
    return f"""{_FILTERED}, {more}{_tgt(method, source, height)}, {_sht(method)}, cv as (select zi, ai, hi, sum(coalesce(w, 0)) over (partition by zi, ai order by hi rows unbounded preceding) / n as cover
        from (select * from sh, (select unnest(range({CUBE.nh}))::int as hi) where n > 0) left join tg using (zi, ai, hi))"""


def _gap_sql(bins: list[int], method: str = "WEIGHTED", source: str = "tp", height: str = "z", more: str = "") -> str:
    return f"{_cov(method, source, height, more)}, gp as (select zi, hi, 1 - avg(cover) as pgap from cv where ai in ({', '.join(map(str, bins))}) group by all)"


_ALL_BINS = profiles.azimuth_bins(CUBE)
_GAP = _gap_sql(_ALL_BINS)
_LN = f"case when pgap > 0 and not isnan(pgap) then ln(pgap) else {expr.LOG_FLOOR!r}::double end"
_HI = f"hs as (select unnest(range({CUBE.nh}))::int as hi)"
_HINGE = f"hg as (select hi, -1.1::double * ({_LN}) as pai from hs left join (select * from gp where zi = {profiles.hinge_ring(CUBE)}) using (hi))"
_XS = "[" + ", ".join(f"{expr.leaf_angle_x(CUBE.zenith(i))!r}::double" for i in range(CUBE.nz)) + "]"
_LINEAR = f"""lf as (select hi, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(y) as my, avg(y / x) as myx from
        (select hi, {_XS}[zi + 1] as x, -({_LN}) as y from (select * from (select unnest(range({CUBE.nz}))::int as zi), hs) left join gp using (zi, hi)) group by hi),
    lh as (select hi, case when a < 0 then myx when b < 0 then 0 else b end as paiv, case when a < 0 then 0 when b < 0 then my else a end as paih from lf),
    ln_ as (select hi, paiv + paih as pai, paiv, paih, degrees(atan2(paiv, paih)) as mla from lh)"""
_WS = "[" + ", ".join(f"{2 * math.pi * math.sin(CUBE.zenith(i)) * math.radians(CUBE.zres)!r}::double" for i in range(CUBE.nz)) + "]"
_WEIGHTED = f"""tops as (select zi, {_LN} as den from gp where hi = {CUBE.nh - 1} and pgap < 1),
    wr as (select hi, sum({_WS}[zi + 1] * ({_LN}) / den) / sum({_WS}[zi + 1]) as ratio from gp join tops using (zi) group by hi),
    wt as (select hi, coalesce(ratio, 0) * (select max(pai) from hg) as pai from hs left join wr using (hi))"""


def _pavd_sql(source: str, name: str) -> str:
    return f"""{name} as (select *, case when lag(pai) over w is null then (lead(pai) over w - pai) / 0.5::double when lead(pai) over w is null then (pai - lag(pai) over w) / 0.5::double
        else (lead(pai) over w - lag(pai) over w) / 1.0::double end as pavd from {source} window w as (order by hi))"""


for _m in profiles.METHODS:

    @R.add(f"targets_{_m.lower()}", f"with {_FILTERED}, {_tgt(_m)} select zi, ai, hi, {r6s('w', 'w')} from tg")
    def _targets(spark, d, method=_m):
        return profiles.targets(_points(spark, d), CUBE, method).select("zi", "ai", "hi", r6("w", "w"))


for _name, _m in (("shots_count", "WEIGHTED"), ("shots_all", "ALL")):

    @R.add(_name, f"with {PUL}, {TURNED}, {_sht(_m)} select zi, ai, n from sh")
    def _shots(spark, d, method=_m):
        return profiles.shots(_pulses(spark, d), CUBE, method)


@R.add("cover_theta_z", f"with {_cov()} select zi, ai, hi, {r6s('cover', 'cover')} from cv")
def cover_theta_z(spark, d):
    c = profiles.cover(profiles.targets(_points(spark, d), CUBE), profiles.shots(_pulses(spark, d), CUBE), CUBE)
    return c.select("zi", "ai", "hi", r6("cover", "cover"))


_AZ = {"pgap_theta_z": {}, "pgap_azimuth": {"min_azimuth": 90, "max_azimuth": 180}, "pgap_azimuth_invert": {"min_azimuth": 90, "max_azimuth": 180, "invert": True}}
for _name, _kw in _AZ.items():

    @R.add(_name, f"with {_gap_sql(profiles.azimuth_bins(CUBE, **_kw))} select zi, hi, {r6s('pgap', 'pgap')} from gp")
    def _pgap(spark, d, kw=_kw):
        return _gap(spark, d, **kw).select("zi", "hi", r6("pgap", "pgap"))


@R.add("pgap_first", f"with {_gap_sql(_ALL_BINS, 'FIRST')} select zi, hi, {r6s('pgap', 'pgap')} from gp")
def pgap_first(spark, d):
    return _gap(spark, d, "FIRST").select("zi", "hi", r6("pgap", "pgap"))


SENSOR_HEIGHT, MAX_HR = 1.5, 20.0
_OVER_GROUND = f"sg as (select t.*, z - (s.tz - {SENSOR_HEIGHT!r}::double) as above from tp t join (select scan_id, tz from scans) s using (scan_id) where range * sin(zenith) < {MAX_HR!r}::double), "


@R.add("profile_riegl", f"with {_gap_sql(_ALL_BINS, 'WEIGHTED', 'sg', 'above', _OVER_GROUND)} select zi, hi, {r6s('pgap', 'pgap')} from gp")
def profile_riegl(spark, d):
    """One profile of all scan positions, each with its ground a sensor height
    below it (no plane), returns within a horizontal range."""
    t = _binned_returns(spark, d, pulses.height_above_sensor_ground(F.col("tz"), SENSOR_HEIGHT), MAX_HR)
    cov = profiles.cover(profiles.targets(t, CUBE), profiles.shots(_pulses(spark, d), CUBE), CUBE)
    return profiles.pgap(cov, CUBE).select("zi", "hi", r6("pgap", "pgap"))


@R.add("pai_hinge", f"with {_GAP}, {_HI}, {_HINGE} select hi, {r6s('pai', 'pai')} from hg")
def pai_hinge(spark, d):
    return profiles.pai_hinge(_gap(spark, d), CUBE).select("hi", r6("pai", "pai"))


@R.add("pai_linear", f"with {_GAP}, {_HI}, {_LINEAR} select hi, {r6s('pai', 'pai')}, {r6s('paiv', 'paiv')}, {r6s('paih', 'paih')} from ln_")
def pai_linear(spark, d):
    return profiles.pai_linear(_gap(spark, d), CUBE).select("hi", r6("pai", "pai"), r6("paiv", "paiv"), r6("paih", "paih"))


@R.add("mla_linear", f"with {_GAP}, {_HI}, {_LINEAR} select hi, {r6s('mla', 'mla')} from ln_")
def mla_linear(spark, d):
    return profiles.pai_linear(_gap(spark, d), CUBE).select("hi", r6("mla", "mla"))


@R.add("pai_weighted", f"with {_GAP}, {_HI}, {_HINGE}, {_WEIGHTED} select hi, {r6s('pai', 'pai')} from wt")
def pai_weighted(spark, d):
    return profiles.pai_weighted(_gap(spark, d), CUBE).select("hi", r6("pai", "pai"))


@R.add("pavd_central", f"with {_GAP}, {_HI}, {_HINGE}, {_pavd_sql('hg', 'pv')} select hi, {r6s('pavd', 'pavd')} from pv")
def pavd_central(spark, d):
    return profiles.pavd(profiles.pai_hinge(_gap(spark, d), CUBE), CUBE.hres).select("hi", r6("pavd", "pavd"))


@R.add("pavd_forward", f"with {_GAP}, {_HI}, {_HINGE} select hi, {r6s('(lead(pai, 1, 0) over (order by hi) - pai) / 0.5::double', 'pavd')} from hg")
def pavd_forward(spark, d):
    return profiles.pavd(profiles.pai_hinge(_gap(spark, d), CUBE), CUBE.hres, central=False).select("hi", r6("pavd", "pavd"))


@R.add("plant_profiles", f"""with {_GAP}, {_HI}, {_HINGE}, {_LINEAR}, {_WEIGHTED}, {_pavd_sql('hg', 'p1')}, {_pavd_sql('ln_', 'p2')}, {_pavd_sql('wt', 'p3')}
    select hi * 0.5::double as Height, {r6s('p1.pai', 'HingePAI')}, {r6s('p2.pai', 'LinearPAI')}, {r6s('p2.mla', 'LinearMLA')}, {r6s('p3.pai', 'WeightedPAI')},
    {r6s('p1.pavd', 'HingePAVD')}, {r6s('p2.pavd', 'LinearPAVD')}, {r6s('p3.pavd', 'WeightedPAVD')} from p1 join p2 using (hi) join p3 using (hi)""")
def plant_profiles(spark, d):
    p = profiles.plant_profiles(_gap(spark, d), CUBE)
    return p.select("Height", *[r6(c, c) for c in p.columns if c != "Height"])


@R.add("pgap_profiles_wide", f"with {_GAP} select hi * 0.5::double as Height, " + ", ".join(
    f"round(max(case when zi = {i} then pgap end), 6) + 0.0 as {profiles.ring_name(CUBE, i)}" for i in range(CUBE.nz)) + " from gp group by hi")
def pgap_profiles_wide(spark, d):
    w = profiles.pgap_wide(_gap(spark, d), CUBE)
    return w.select("Height", *[r6(c, c) for c in w.columns if c != "Height"])


@R.add("profiles_csv", f"""with {_GAP}, {_HI}, {_HINGE}, {_pavd_sql('hg', 'pv')} select printf('%.5f', hi * 0.5::double) as Height, printf('%.5f', round(pai, 4) + 0.0) as HingePAI, printf('%.5f', round(pavd, 4) + 0.0) as HingePAVD from pv""")
def profiles_csv(spark, d):
    """A profile written as CSV, its text read back."""
    p = profiles.pavd(profiles.pai_hinge(_gap(spark, d), CUBE), CUBE.hres)
    path = fresh_path(spark, "profile")
    rounded = lambda c, name: (F.round(c, 4) + F.lit(0.0)).alias(name)
    sinks.write_profiles(p.select((F.col("hi") * CUBE.hres).alias("Height"), rounded("pai", "HingePAI"), rounded("pavd", "HingePAVD")), path)
    return spark.read.option("header", True).csv(path)


_LZ, _LH = (math.radians(v) for v in (LEAF_CUBE.min_z, LEAF_CUBE.max_z))


@R.add("profile_leaf", f"""with {LEAF_GEO}, w as (select * from lg where zenith >= {_LZ!r}::double and zenith < {_LH!r}::double and {fd('azimuth', math.radians(360))} = 0), hs as (select unnest(range({LEAF_CUBE.nh}))::int as hi),
    r as (select {fd('h', 0.5)} as hi, 0.5::double as w from (select h1 as h from w where h1 is not null union all select h2 from w where h2 is not null)),
    t as (select hi, sum(w) as w from r where hi between 0 and {LEAF_CUBE.nh - 1} group by hi), n as (select count(*)::double as n from w)
    select hi, {r6s('1 - sum(coalesce(w, 0)) over (order by hi rows unbounded preceding) / n', 'pgap')} from hs left join t using (hi), n where n > 0""")
def profile_leaf(spark, d):
    s = profiles.zenith_window(leaf_geometry(spark, d), LEAF_CUBE.min_z, LEAF_CUBE.max_z)
    t, n = profiles.leaf_cube(s, LEAF_CUBE, "FIRSTLAST")
    g = profiles.pgap(profiles.cover(t, n, LEAF_CUBE), LEAF_CUBE)
    return g.select("hi", r6("pgap", "pgap"))


QUERIES, SQL = R.queries, R.sql

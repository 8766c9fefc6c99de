"""Queries of the voxel model, all from the traversal of every pulse, with and
without returns. The SQL walks the same rays step by step in a recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gapfold.functions import expr
from gapfold.operators import pulses, voxels
from gapfold.operators.voxels import Box
from gapfold.plans.common import KEY, MOVED, PUL, Registry, fd, moved, r6, r6s, shots
from gapfold.session import fresh_path
from gapfold.sources import sinks
from gapfold.sources.tables import table

R = Registry()
BOX = Box((-25, -25, -15, 25, 25, 45), 1.0)
COARSE = Box((-40, -40, -10, 40, 40, 30), 4.0)
DTM_SIZE, DTM_X, DTM_Y, DTM_RES = 60, -60.0, 60.0, 2.0


def dtm(spark):
    """A terrain by formula on a lattice."""
    rows = spark.range(DTM_SIZE).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(DTM_SIZE - 1))))
    r, c = F.col("row"), F.col("col")
    return rows.withColumn("val", 0.02 * r - 0.03 * c + 0.0005 * r * c - 1.0)


_DTM = f"""dtm as (select r::int as row, c::int as col, 0.02::double * r - 0.03::double * c + 0.0005::double * r * c - 1.0::double as val from (select unnest(range({DTM_SIZE})) as r), (select unnest(range({DTM_SIZE})) as c))"""


@R.add("dtm_scan", f"with {_DTM} select row, col, {r6s('val', 'val')}, {DTM_X!r}::double as xmin, {DTM_Y!r}::double as ymax, {DTM_RES!r}::double as res from dtm where row between 10 and 39 and col between 5 and 44")
def dtm_scan(spark, d):
    """A stored terrain read back: its place, and the cells of a window."""
    path = fresh_path(spark, "terrain")
    sinks.write_terrain(dtm(spark), path, DTM_X, DTM_Y, DTM_RES)
    t = sinks.read_terrain(spark, path, rows=(10, 39), cols=(5, 44))
    return t.select("row", "col", r6("val", "val"), "xmin", "ymax", "res")


_NX, _NY, _NZ = COARSE.n


_GROUND = f"""{MOVED}, {_DTM}, dp as (select p.*, val from (select *, {fd('60 - y', 2.0)} as row, {fd('x - (-60)', 2.0)} as col from tp) p left join dtm using (row, col))"""


@R.add("dtm_lookup", f"with {_GROUND} select scan_id, riegl_id, {r6s('val', 'dtm')} from dp")
def dtm_lookup(spark, d):
    g = voxels.with_ground(moved(spark, d), dtm(spark), DTM_X, DTM_Y, DTM_RES)
    return g.select("scan_id", "riegl_id", r6("dtm", "dtm"))


@R.add("ground_classify", f"with {_GROUND} select scan_id, riegl_id, coalesce(z < val + 0.25::double, false) as ground from dp")
def ground_classify(spark, d):
    return voxels.with_ground(moved(spark, d), dtm(spark), DTM_X, DTM_Y, DTM_RES).select("scan_id", "riegl_id", "ground")


@R.add("ground_voxels", f"""with {_DTM}, xy as (select x::int as x, y::int as y, -40 + x * 4.0::double + 2 as xc, 40 - (y * 4.0::double + 2) as yc from (select unnest(range({_NX})) as x), (select unnest(range({_NY})) as y)),
    c as (select *, {fd('60 - yc', 2.0)} as row, {fd('xc - (-60)', 2.0)} as col from xy) select x, y, z::int as z from c join dtm using (row, col), (select unnest(range({_NZ})) as z) where -10 + z * 4.0::double + 2 < val""")
def ground_voxels(spark, d):
    return voxels.ground_voxels(spark, dtm(spark), COARSE, DTM_X, DTM_Y, DTM_RES)


def _rays(spark, d):
    s = table(spark, d, "scans")
    return pulses.transformed_pulses(shots(spark, d), s)


def _slab(i: int, box: Box = BOX) -> tuple[str, str]:
    a, lo, hi = "xyz"[i], float(box.bounds[i]), float(box.bounds[i + 3])
    o, v = f"o{a}", f"d{a}"
    inside = f"{o} >= {lo!r}::double and {o} <= {hi!r}::double"
    near = f"case when {v} = 0 then case when {inside} then -1e300::double else 1e300::double end else least(({lo!r}::double - {o}) / nullif({v}, 0), ({hi!r}::double - {o}) / nullif({v}, 0)) end"
    far = f"case when {v} = 0 then case when {inside} then 1e300::double else -1e300::double end else greatest(({lo!r}::double - {o}) / nullif({v}, 0), ({hi!r}::double - {o}) / nullif({v}, 0)) end"
    return near, far


_RAYS = f"{PUL}, ry as (select scan_id, scanline, scanline_idx, pulse_id, " + ", ".join(
    f"beam_direction_x * r0{j} + beam_direction_y * r1{j} + beam_direction_z * r2{j} as d{a}, beam_origin_x * r0{j} + beam_origin_y * r1{j} + beam_origin_z * r2{j} + t{a} as o{a}" for j, a in enumerate("xyz")) + " from pul join scans using (scan_id))"


@R.add("ray_box", f"with {_RAYS}, tt as (select scan_id, pulse_id, greatest({', '.join(_slab(i)[0] for i in range(3))}) as lo, least({', '.join(_slab(i)[1] for i in range(3))}) as hi from ry) select scan_id, pulse_id, (lo <= hi and hi >= 0) as hit, " + ", ".join(
    f"round(case when lo <= hi and hi >= 0 then {c} end, 6) + 0.0 as {n}" for c, n in (("lo", "tmin"), ("hi", "tmax"))) + " from tt")
def ray_box(spark, d):
    o, v = [F.col(f"beam_origin_{a}") for a in "xyz"], [F.col(f"beam_direction_{a}") for a in "xyz"]
    hit, lo, hi = voxels.ray_box(o, v, BOX)
    return _rays(spark, d).select("scan_id", "pulse_id", hit.alias("hit"), r6(lo, "tmin"), r6(hi, "tmax"))


def _voxels(spark, d, box, ground=False):
    p = moved(spark, d)
    if ground:
        p = voxels.with_ground(p, dtm(spark), DTM_X, DTM_Y, DTM_RES)
    return _rays(spark, d), p, F.col("ground") if ground else None


#: Returns of a pulse that the SQL looks at; the scanners give no more.
_SQL_RETURNS = 18


def _walk_sql(box: Box, ground: bool = False) -> str:
    """CTE `vx` (scan_id, vidx and the sums) of the traversal of all rays: one
    row per ray and step in a recursion, the returns of a ray one after the
    other within a step."""
    n, lo, dim, axes = box.n, [float(v) for v in box.bounds[:3]], box.dim, "xyz"
    near, far = zip(*(_slab(i, box) for i in range(3)))
    flag = "coalesce(z < val + 0.25::double, false)" if ground else "false"
    source = f"dp as (select p.*, val from (select *, {fd('60 - y', 2.0)} as row, {fd('x - (-60)', 2.0)} as col from tp) p left join dtm using (row, col)), " if ground else ""
    cell = lambda v, i: f"floor(({v} - {lo[i]!r}::double) / {dim[i]!r}::double * {n[i]})"
    vox = lambda a: f"{a[0]} + {n[0]} * {a[1]} + {n[0] * n[1]} * {a[2]}"
    inside = lambda a: " and ".join(f"{a[i]} >= 0 and {a[i]} < {n[i]}" for i in range(3))
    t = [cell(v, i) for i, v in enumerate(axes)]
    target = f"case when {inside(t)} then cast({vox(t)} as bigint) else -1 end"
    state = "scan_id, ray, w, cnt, tg, gd, sx, sy, sz, ex, ey, ez, theta, cx, cy, cz, tx, ty, tz, wmiss, woccl, last, t_left, voxel, hits, missed, length"
    step = "walk"
    body = f"""select *, cast({vox(['cx', 'cy', 'cz'])} as bigint) as vn, case when tx < ty then case when tx < tz then 0 else 2 end else case when ty < tz then 1 else 2 end end as ax from walk where {inside(['cx', 'cy', 'cz'])}"""
    body = f"""select * exclude (ax, vn, voxel, hits, missed, length) replace ({", ".join(f"case when ax = {i} then c{a} + s{a} else c{a} end as c{a}, case when ax = {i} then t{a} + e{a} else t{a} end as t{a}" for i, a in enumerate(axes))}),
        vn as voxel, 0.0::double as hits, false as missed from ({body})"""
    for i in range(1, _SQL_RETURNS + 1):
        body = f"""select * exclude (here, other) replace (hits + case when here and not gd[{i}] then w else 0 end as hits, woccl + case when here and gd[{i}] then w when other and last then w else 0 end as woccl,
            wmiss - case when here then w else 0 end as wmiss, (last or here) and not other as last, missed or other as missed)
            from (select *, {i} <= cnt and tg[{i}] = voxel as here, {i} <= cnt and tg[{i}] <> voxel as other from ({body}))"""
    body = f"select * replace (case when abs(wmiss) < 1e-12::double then 0.0::double else wmiss end as wmiss, least(tx, ty, tz) as t_left), least(tx, ty, tz) - t_left as length from ({body})"
    names = ", ".join(c for c in state.split(", "))
    start = [f"o{a} + t0 * d{a}" for a in axes]
    first = lambda i: f"case when {cell(start[i], i)} = {n[i]} then {n[i] - 1} else {cell(start[i], i)} end"
    edge = lambda i: f"({lo[i]!r}::double + (c{axes[i]} + (s{axes[i]} > 0)::int) / {n[i]}::double * {dim[i]!r}::double)"
    return f"""{MOVED}, {_RAYS}, {_DTM}, {source}
        rt as (select {KEY}, list({target} order by target_index, x, y, z) as tg, list({flag} order by target_index, x, y, z) as gd from {'dp' if ground else 'tp'} group by all),
        ry1 as (select r.*, greatest(0.0::double, greatest({", ".join(near)})) as t0 from ry r where not (dx = 0 and dy = 0 and dz = 0) and greatest({", ".join(near)}) <= least({", ".join(far)}) and least({", ".join(far)}) >= 0),
        ry2 as (select scan_id, row_number() over () as ray, coalesce(len(tg), 0) as cnt, coalesce(tg, []) as tg, coalesce(gd, []) as gd, t0, ox, oy, oz, dx, dy, dz,
            sign(dx)::bigint as sx, sign(dy)::bigint as sy, sign(dz)::bigint as sz, acos(least(greatest(dz / sqrt(dx * dx + dy * dy + dz * dz), -1), 1)) as theta,
            {", ".join(f"cast({first(i)} as bigint) as c{axes[i]}" for i in range(3))} from ry1 left join rt using ({KEY})),
        ry3 as (select *, {", ".join(f"case when s{a} = 0 then 'inf'::double else t0 + ({edge(i)} - (o{a} + t0 * d{a})) / d{a} end as t{a}, case when s{a} = 0 then 'inf'::double else {box.size!r}::double / abs(d{a}) end as e{a}" for i, a in enumerate(axes))} from ry2),
        walk as (select scan_id, ray, case when cnt > 0 then 1.0::double / cnt else 0.0::double end as w, cnt, tg, gd, sx, sy, sz, ex, ey, ez, theta, cx, cy, cz, tx, ty, tz, 1.0::double as wmiss, 0.0::double as woccl, false as last,
                least(tx, ty, tz) as t_left, -1::bigint as voxel, 0.0::double as hits, false as missed, 0.0::double as length from ry3
            union all select {names} from ({body})),
        vx as (select scan_id, voxel as vidx, sum(hits) as hits, sum(wmiss) as miss, sum(woccl) as occl, sum(theta) as zeni, sum(case when w > 0 then hits / w * length else 0 end) as phit, sum(case when missed then length else 0 end) as pmiss
            from walk where voxel >= 0 group by all)"""


_SUMS = ["hits", "miss", "occl", "zeni", "phit", "pmiss"]


def _xyz_sql(box: Box) -> str:
    nx, ny, _ = box.n
    return f"(vidx % {nx})::int as x, ((vidx // {nx}) % {ny})::int as y, (vidx // {nx * ny})::int as z"


_CLASS = "case when hits > 0 and miss >= 0 and occl >= 0 then 5 when hits = 0 and miss > 0 and occl >= 0 then 4 when hits = 0 and miss = 0 and occl > 0 then 3 when hits = 0 and miss = 0 and occl = 0 then 2 end"
_RATIOS = """case when hits + miss > 0 then phit + pmiss end as vwts, case when hits + miss > 0 then miss / (hits + miss) end as pgap, case when hits + miss + occl > 0 then zeni / (hits + miss + occl) end as zeni"""


@R.add("voxel_traverse", f"with recursive {_walk_sql(COARSE)} select scan_id, vidx, {', '.join(r6s(c, c) for c in _SUMS)} from vx")
def voxel_traverse(spark, d):
    u, p, _ = _voxels(spark, d, COARSE)
    return voxels.traverse(voxels.rays(u, p, COARSE), COARSE).select("scan_id", "vidx", *[r6(c, c) for c in _SUMS])


@R.add("voxel_counts", f"with recursive {_walk_sql(BOX)} select scan_id, {_xyz_sql(BOX)}, {', '.join(r6s(c, c) for c in _SUMS)} from vx")
def voxel_counts(spark, d):
    u, p, _ = _voxels(spark, d, BOX)
    return voxels.with_xyz(voxels.traverse(voxels.rays(u, p, BOX), BOX), BOX).select("scan_id", "x", "y", "z", *[r6(c, c) for c in _SUMS])


_VOXEL = ["hits", "miss", "occl", "vwts", "pgap", "zeni"]


@R.add("voxelize_scan", f"with recursive {_walk_sql(BOX, True)} select scan_id, {_xyz_sql(BOX)}, {', '.join(r6s(c, c, 9) for c in _VOXEL)}, vcls from (select scan_id, vidx, hits, miss, occl, {_RATIOS}, {_CLASS} as vcls from vx)")
def voxelize_scan(spark, d):
    u, p, g = _voxels(spark, d, BOX, True)
    return voxels.voxelize(u, p, BOX, g).select("scan_id", "x", "y", "z", *[r6(c, c, 9) for c in _VOXEL], "vcls")


def stack(spark, d):
    """A voxel table per scan from the traversal of all pulses."""
    u, p, _ = _voxels(spark, d, COARSE)
    return voxels.voxelize(u, p, COARSE)


_STACK = f"recursive {_walk_sql(COARSE)}, sr as (select scan_id, {_xyz_sql(COARSE)}, hits, miss, occl, {_RATIOS}, {_CLASS} as vcls from vx)"
_LIN = f"""ld as (select x, y, z, vwts as w, abs(2 * tan(zeni) / {math.pi!r}::double) as t, -(case when pgap > 0 and not isnan(pgap) then ln(pgap) else {expr.LOG_FLOOR!r}::double end) as k, vwts from sr where zeni is not null and pgap is not null and vwts is not null),
    ls_ as (select x, y, z, count(*) as n, sum(w) as sw, sum(w * t) as st_, sum(w * k) as sk, sum(w * t * t) as stt, sum(w * t * k) as stk, avg(k) as mk, avg(k / nullif(t, 0)) as mkt, sum((vwts > 0)::int)::bigint as nscans from ld group by all having count(*) >= 3),
    lb as (select *, sw * stt - st_ * st_ as det, st_ / nullif(sw, 0) as mt, sk / nullif(sw, 0) as mkk from ls_),
    lc as (select *, abs(det) <= 1e-12::double * sw * stt as flat, mkk / (1 + mt * mt) as one_ from lb),
    lm0 as (select *, case when flat then coalesce(one_ * mt, 0) else (sw * stk - st_ * sk) / nullif(det, 0) end as b from lc),
    lm1 as (select *, case when flat then coalesce(one_, 0) else mkk - b * mt end as a from lm0),
    lm as (select x, y, z, case when a < 0 then mkt when b < 0 then 0 else b end as paiv, case when a < 0 then 0 when b < 0 then mk else a end as paih, nscans from lm1)"""


@R.add("voxel_ratios", f"with {_STACK} select scan_id, x, y, z, {", ".join(r6s(c, c, 9) for c in ("vwts", "pgap", "zeni"))} from sr")
def voxel_ratios(spark, d):
    return stack(spark, d).select("scan_id", "x", "y", "z", *[r6(c, c, 9) for c in ("vwts", "pgap", "zeni")])


@R.add("voxel_class", f"with {_STACK} select scan_id, x, y, z, vcls from sr")
def voxel_class(spark, d):
    return stack(spark, d).select("scan_id", "x", "y", "z", "vcls")


#: Layers read from the stored stack.
_LAYERS = (2, 4)


@R.add("voxel_stack", f"with {_STACK} select scan_id, x, y, z, {', '.join(r6s(c, c) for c in ('hits', 'miss', 'occl'))} from sr where z between {_LAYERS[0]} and {_LAYERS[1]}")
def voxel_stack(spark, d):
    """The stack stored layer by layer, and some of its layers and names read
    back."""
    path = fresh_path(spark, "voxels")
    sinks.write_voxels(stack(spark, d), path)
    v = sinks.read_voxels(spark, path, range(_LAYERS[0], _LAYERS[1] + 1), ["hits", "miss", "occl"])
    return v.select("scan_id", "x", "y", "z", *[r6(c, c) for c in ("hits", "miss", "occl")])


@R.add("voxel_linear", f"with {_STACK}, {_LIN} select x, y, z, {r6s('paiv', 'paiv')}, {r6s('paih', 'paih')}, nscans from lm")
def voxel_linear(spark, d):
    m = voxels.linear_model(stack(spark, d))
    return m.select("x", "y", "z", r6("paiv", "paiv"), r6("paih", "paih"), "nscans")


@R.add("cover_profile", f"""with {_STACK}, {_LIN} select x, y, z, {r6s(f'1 - exp(-sum(case when z < {_NZ - 1} then coalesce(paiv, 0) else 0 end) over (partition by x, y order by z desc rows unbounded preceding))', 'cover')} from lm""")
def cover_profile(spark, d):
    m = voxels.linear_model(stack(spark, d))
    return voxels.cover_profile(m, COARSE.n[2]).select("x", "y", "z", r6("cover", "cover"))


@R.add("voxel_occlusion", f"with {_STACK} select x, y, z, {r6s('sum(occl) / nullif(sum(occl) + sum(miss) + sum(hits), 0)', 'poccl')}, {r6s('sum(occl) + sum(miss) + sum(hits)', 'nbeam')} from sr group by x, y, z")
def voxel_occlusion(spark, d):
    return voxels.occlusion(stack(spark, d)).select("x", "y", "z", r6("poccl", "poccl"), r6("nbeam", "nbeam"))


@R.add("voxel_nscans", f"with {_STACK} select x, y, z, sum(case when vwts > 0 then 1 else 0 end)::bigint as nscans from sr group by x, y, z")
def voxel_nscans(spark, d):
    return voxels.scan_counts(stack(spark, d))


@R.add("voxel_box", "select " + ", ".join(f"{v!r} as {k}" for k, v in zip(("nx", "ny", "nz"), BOX.n)) + ", " + ", ".join(f"{v!r}::double as {k}" for k, v in zip(("dx", "dy", "dz"), BOX.dim)) + ", 1.0::double as size")
def voxel_box(spark, d):
    """Voxels along each axis and their extent, from the stored configuration."""
    path = fresh_path(spark, "config")
    sinks.write_json(spark, BOX.config(), path)
    box = Box.from_config(sinks.read_json(spark, path))
    return spark.createDataFrame([(*box.n, *box.dim, box.size)], "nx int, ny int, nz int, dx double, dy double, dz double, size double")


QUERIES, SQL = R.queries, R.sql

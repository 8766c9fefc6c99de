"""Queries that grid returns, and the ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfold.functions import expr, predicate
from gapfold.operators import grids, ground, pulses
from gapfold.plans.common import LEAF_GEO, MOVED, PTS, Registry, fd, leaf_geometry, moved, points, r6, r6s
from gapfold.session import fresh_path
from gapfold.sources import sinks

R = Registry()
_RES, _ROWS, _COLS = grids.spherical_shape(1.0)
_PLANE = (0.5, 0.01, -0.02)


def _cart_sql(value: str, agg: str, where: str = "true") -> str:
    x, y = fd("x - (-25)", 0.5), fd("25 - y", 0.5)
    return f"""with {MOVED}, c as (select {x} as xi, {y} as yi, {value} as v from tp where {where})
        select 0 as z, yi as y, xi as x, {r6s(f'{agg}(v)', 'value')}, count(v) as cnt from c where v is not null and not isnan(v) and xi between 0 and 100 and yi between 0 and 100 group by yi, xi"""


def _out(grid):
    return grid.select("z", "y", "x", r6("value", "value"), "cnt")


for _name, _agg in (("mean", "avg"), ("sum", "sum"), ("max", "max"), ("min", "min")):

    @R.add(f"grid_{_name}", _cart_sql("reflectance", _agg))
    def _grid(spark, d, method=_name.upper()):
        return _out(grids.cartesian(moved(spark, d), 0.5, F.col("reflectance"), method))


@R.add("grid_cartesian_max", _cart_sql("z", "max", "reflectance > -20 and not isnan(reflectance)"))
def grid_cartesian_max(spark, d):
    p = pulses.transformed(predicate.where(points(spark, d), "reflectance > -20"), _scans(spark, d))
    return _out(grids.cartesian(p, 0.5, F.col("z"), "MAX"))


def _scans(spark, d):
    from gapfold.sources.tables import table

    return table(spark, d, "scans")


@R.add("grid_height_max", _cart_sql("z - (0.01::double * x + (-0.02)::double * y + 0.5::double)", "max"))
def grid_height_max(spark, d):
    return _out(grids.cartesian(moved(spark, d), 0.5, pulses.height_above_plane(_PLANE), "MAX"))


def _sph_sql(source: str, name: str, value: str, agg: str, band: str = "0", bands: int = 1) -> str:
    return f"""with {source}, c as (select {band} as zi, {fd('zenith', _RES)} as yi, {fd('azimuth', _RES)} as xi, {value} as v from {name})
        select zi as z, yi as y, xi as x, {r6s(f'{agg}(v)', 'value')}, count(v) as cnt from c
        where v is not null and not isnan(v) and xi between 0 and {_COLS - 1} and yi between 0 and {_ROWS - 1} and zi between 0 and {bands - 1} group by zi, yi, xi"""


@R.add("grid_spherical_mean", _sph_sql(MOVED, "tp", "reflectance", "avg"))
def grid_spherical_mean(spark, d):
    return _out(grids.spherical(moved(spark, d), 1.0, F.col("reflectance"), "MEAN"))


@R.add("grid_spherical_range", _sph_sql(MOVED, "tp", "reflectance", "max", fd("range", 10.0), 13))
def grid_spherical_range(spark, d):
    return _out(grids.spherical_ranges(moved(spark, d), 1.0, 10.0, 120.0, F.col("reflectance"), "MAX"))


@R.add("grid_leaf_spherical", _sph_sql(LEAF_GEO, "lg", "range1", "min"))
def grid_leaf_spherical(spark, d):
    return _out(grids.spherical(leaf_geometry(spark, d), 1.0, F.col("range1"), "MIN"))


@R.add("scan_grid", f"""with {PTS} select scan_id, (target_index - 1)::int as z, scanline_idx as y, scanline as x, arg_max(reflectance, struct_pack(loaded_at := loaded_at, riegl_id := riegl_id)) + 0.0 as value
    from pts where reflectance is not null and not isnan(reflectance) group by all""")
def scan_grid(spark, d):
    return grids.scan_grid(points(spark, d), "reflectance", ["loaded_at", "riegl_id"]).withColumn("value", F.col("value") + 0.0)


@R.add("grid_overview", f"""with g as ({_cart_sql('reflectance', 'avg').replace('round(avg(v), 6) + 0.0 as value', 'avg(v) as value')})
    select z, y // 4 as y, x // 4 as x, {r6s('avg(value)', 'value', 9)} from g group by all""")
def grid_overview(spark, d):
    g = grids.overview(grids.cartesian(moved(spark, d), 0.5, F.col("reflectance"), "MEAN"), 4)
    return g.select("z", "y", "x", r6("value", "value", 9))


_BASE = f"g as ({_cart_sql('reflectance', 'avg').replace('round(avg(v), 6) + 0.0 as value', 'avg(v) as value')})"
_PYRAMID = " union all ".join(f"select {f} as factor, z as band, y // {f} as row, x // {f} as col, {r6s('avg(value)', 'value', 9)}, 'Reflectance' as description from g group by all" for f in (1, 2, 4, 8))


@R.add("grid_pyramid", f"with {_BASE} {_PYRAMID}")
def grid_pyramid(spark, d):
    """A grid stored with its overviews and band descriptions, read back."""
    path = fresh_path(spark, "pyramid")
    sinks.write_pyramid(grids.cartesian(moved(spark, d), 0.5, F.col("reflectance"), "MEAN"), path, ["Reflectance"])
    g = spark.read.parquet(path)
    return g.select("factor", "band", "row", "col", r6("value", "value", 9), "description")


_MINZ = f"""{MOVED}, c as (select {fd('25 - y', 5.0)} as yi, {fd('x - (-25)', 5.0)} as xi, x, y, z, range, scan_id, riegl_id from tp where not isnan(z)),
    mz as (select yi, xi, arg_min(struct_pack(px := x, py := y, pz := z, r := range), struct_pack(z := z, s := scan_id, i := riegl_id)) as p from c where xi between 0 and 10 and yi between 0 and 10 group by all)"""


@R.add("min_z_grid", f"with {_MINZ} select yi as y, xi as x, {r6s('p.px', 'px')}, {r6s('p.py', 'py')}, {r6s('p.pz', 'pz')}, {r6s('p.r', 'r')} from mz")
def min_z_grid(spark, d):
    g = ground.min_z_grid(moved(spark, d), 50, 5)
    return g.select("y", "x", *[r6(c, c) for c in ("px", "py", "pz", "r")])


def _plane_sql(cells: str) -> str:
    """CTE `pl` (a, b, c): Huber's plane through `cells` (y, x, px, py, pz, r) by
    reweighted least squares, the normal equations solved by determinants."""
    each = lambda e: f"list_transform(range(1, n + 1), lambda i: {e})"
    own = "xs, ys, zs, ws, n"
    sums = {"s0": "1", "sx": "xs[i]", "sy": "ys[i]", "sz": "zs[i]", "sxx": "xs[i] * xs[i]", "sxy": "xs[i] * ys[i]", "syy": "ys[i] * ys[i]", "sxz": "xs[i] * zs[i]", "syz": "ys[i] * zs[i]"}

    def solved(source: str) -> str:
        total = ", ".join(f"list_sum({each(f'ws[i] * ws[i] * ks[i] * ({e})')}) as {name}" for name, e in sums.items())
        return f"""select {own}, k, dev, done, (sz * (sxx * syy - sxy * sxy) - sx * (sxz * syy - sxy * syz) + sy * (sxz * sxy - sxx * syz)) / det as a,
            (s0 * (sxz * syy - sxy * syz) - sz * (sx * syy - sxy * sy) + sy * (sx * syz - sxz * sy)) / det as b,
            (s0 * (sxx * syz - sxz * sxy) - sx * (sx * syz - sxz * sy) + sz * (sx * sxy - sxx * sy)) / det as c
            from (select *, s0 * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) as det from (select *, {total} from ({source})))"""

    first = f"select {own}, {each('1.0::double')} as ks, 'inf'::double as dev, false as done, 0 as k from cells"
    huber = each("case when us[i] <= 1.345::double then us[i] * us[i] / 2 else 1.345::double * us[i] - 1.345::double * 1.345::double / 2 end")
    step = f"""select {own}, k + 1 as k, {each("case when us[i] <= 1.345::double then 1.0::double else 1.345::double / us[i] end")} as ks, now as dev, abs(dev - now) < 1e-8::double as done
        from (select *, list_sum({huber}) as now from (select *, {each("res[i] / scale")} as us from (select *, list_median(res) / 0.6744897501960817::double as scale
            from (select {own}, k, dev, {each("abs(ws[i] * zs[i] - ws[i] * (a + b * xs[i] + c * ys[i]))")} as res from fit where k < 50 and not done)) where scale > 0))"""
    return f"""cells as (select list(px order by y, x) as xs, list(py order by y, x) as ys, list(pz order by y, x) as zs, list(1 / r order by y, x) as ws, count(*) as n from ({cells}) where r > 0),
        fit as ({solved(first)} union all {solved(step)}), pl as (select a, b, c from fit order by k desc limit 1)"""


_PLANE_OUT = f"""select {r6s('a', 'intercept')}, {r6s('b', 'bx')}, {r6s('c', 'cy')}, {r6s('degrees(atan(sqrt(b * b + c * c)))', 'slope')},
    {r6s('case when c <> 0 then degrees(atan(b / c)) else sign(b) * 90.0::double end', 'aspect')} from pl"""


def _plane(spark, p):
    f = ground.plane_frame(spark, p)
    return f.select(*[r6(c, c) for c in f.columns])


@R.add("plane_fit", f"with recursive {_MINZ}, {_plane_sql('select yi as y, xi as x, p.* from mz')} {_PLANE_OUT}")
def plane_fit(spark, d):
    return _plane(spark, ground.ground_plane(moved(spark, d), 50, 5))


_AUTO = f"""{MOVED}, ends as (select min(x) as x0, max(y) as y1, greatest(max(x) - min(x), max(y) - min(y)) as extent from tp),
    c as (select {fd('(y1 - extent / 2) + extent / 2 - y', 10.0)} as yi, {fd('x - ((x0 + extent / 2) - extent / 2)', 10.0)} as xi, (extent // 10)::bigint + 1 as n, x, y, z, range, scan_id, riegl_id from tp, ends where not isnan(z)),
    mz as (select yi, xi, arg_min(struct_pack(px := x, py := y, pz := z, r := range), struct_pack(z := z, s := scan_id, i := riegl_id)) as p from c where xi between 0 and n - 1 and yi between 0 and n - 1 group by all)"""


@R.add("ground_plane", f"with recursive {_AUTO}, {_plane_sql('select yi as y, xi as x, p.* from mz')} {_PLANE_OUT}")
def ground_plane(spark, d):
    return _plane(spark, ground.ground_plane_auto(moved(spark, d), 10))


@R.add("plane_surface", f"select x::double as x, y::double as y, {r6s('0.5::double + 0.01::double * x + (-0.02)::double * y', 'z')} from (select unnest(range(-30, 31)) as x), (select unnest(range(-30, 31)) as y)")
def plane_surface(spark, d):
    return ground.plane_surface(spark, _PLANE, -30, 30, -30, 30).select("x", "y", r6("z", "z"))


@R.add("sum_by_index_1d", f"with {MOVED} select {fd('range', 1.0)} as idx, {r6s('sum(1.0::double / target_count)', 'value')} from tp where target_count > 0 and range is not null and not isnan(range) group by 1")
def sum_by_index_1d(spark, d):
    from gapfold.operators.profiles import sum_by_index

    p = moved(spark, d).where("target_count > 0 and range is not null and not isnan(range)").withColumn("idx", expr.bin_index(F.col("range"), 1.0))
    return sum_by_index(p, ["idx"], F.lit(1.0) / F.col("target_count")).select("idx", r6("value", "value"))


QUERIES, SQL = R.queries, R.sql

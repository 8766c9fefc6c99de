"""Queries over LEAF scans, and their time series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gapfold.functions import expr
from gapfold.operators import grids, leaf, profiles, series
from gapfold.operators.profiles import Cube
from gapfold.plans import data
from gapfold.plans.common import LEAF, LEAF_ANGLES, LEAF_GEO, Registry, fd, leaf_geometry, leaf_shots, r6, r6s
from gapfold.session import written
from gapfold.sources import leaf_files
from gapfold.sources.tables import table

R = Registry()
_NAME = leaf_files.SCAN_NAME
_UNITS = ", ".join(f"'{k}'" for k in leaf_files.UNIT_KEYS)


def _part(i: int) -> str:
    return f"nullif(regexp_extract(file_name, '{_NAME}', {i}), '')"


@R.add("leaf_filename", f"""select file_id, {_part(1)} as serial_number, {_part(2)}::int as scan_count, {_part(3)} as scan_type, epoch({"try_strptime(" + _part(4) + ", '%Y%m%d-%H%M%S')"})::bigint as at,
    {_part(5)}::int as zenith_shots, {_part(6)}::int as azimuth_shots from leaf_files""")
def leaf_filename(spark, d):
    c = leaf_files.file_name_fields(F.col("file_name"))
    return table(spark, d, "leaf_files").select("file_id", c["serial_number"].alias("serial_number"), c["scan_count"].alias("scan_count"), c["scan_type"].alias("scan_type"),
                                                F.unix_seconds(c["datetime"].cast("timestamp")).alias("at"), c["zenith_shots"].alias("zenith_shots"), c["azimuth_shots"].alias("azimuth_shots"))


@R.add("leaf_meta", r"""with fb as (select file_id, min(line_no) as f from leaf_lines where line_text is not null and not starts_with(line_text, '#') and trim(line_text, ' ' || chr(9) || chr(13)) <> '' group by 1),
    n as (select file_id, line_no, f, trim(line_text) as t from leaf_lines left join fb using (file_id) where starts_with(line_text, '#')),
    k as (select file_id, line_no, case when f is null or line_no < f then 'header' else 'footer' end as section,
        case when regexp_matches(t, '^#\s*Finished') then 'Finished' when regexp_matches(t, '^#\s*GPS') then 'GPS' else trim(regexp_extract(t, '^#\s*([^:]*):', 1)) end as key,
        case when regexp_matches(t, '^#\s*Finished') then regexp_extract(t, '^#\s*Finished\s+(\S+)', 1) when regexp_matches(t, '^#\s*GPS') then trim(regexp_extract(t, '^#\s*GPS:?(.*)$', 1))
        when trim(regexp_extract(t, '^#\s*([^:]*):', 1)) in (""" + _UNITS + r""") then regexp_extract(trim(regexp_extract(t, '^#[^:]*:(.*)$', 1)), '^(\S+)', 1)
        else trim(regexp_extract(t, '^#[^:]*:(.*)$', 1)) end as value from n)
    select file_id, section, key, arg_max(value, line_no) as value from k where key <> '' group by all""")
def leaf_meta(spark, d):
    return leaf_files.meta(table(spark, d, "leaf_lines"))


@R.add("leaf_scan", data.SQL["p5_rows"])
def leaf_scan(spark, d):
    from gapfold.operators.badrows import good_rows

    return good_rows(table(spark, d, "leaf_lines"))


@R.add("leaf_discovery", f"select file_name, min(file_id) as file_id from leaf_files where regexp_matches(file_name, '{_NAME}') and file_name like '%\\_hinge\\_%' escape '\\' group by 1 order by 1")
def leaf_discovery(spark, d):
    """The hinge scans' files, each name once, in order of name (which is that of
    time within an instrument)."""
    return leaf_files.discovered(table(spark, d, "leaf_files"), "hinge")


@R.add("leaf_power", "select serial_number, epoch(datetime)::bigint as at, max(battery_voltage) as battery_voltage, max(current) as current, max(temperature) as temperature, max(humidity) as humidity from leaf_power where humidity is not null and not isnan(humidity) group by 1, 2")
def leaf_power(spark, d):
    p = leaf_files.power_rows(table(spark, d, "leaf_power"))
    return p.select("serial_number", F.unix_seconds(F.col("datetime").cast("timestamp")).alias("at"), "battery_voltage", "current", "temperature", "humidity")


@R.add("leaf_invalidate", f"with {LEAF} select scan_id, seq, range1, range2 from ls")
def leaf_invalidate(spark, d):
    return leaf_shots(spark, d).select("scan_id", "seq", "range1", "range2")


@R.add("leaf_target_count", f"with {LEAF} select scan_id, seq, 2 - (range1 is null)::int - (range2 is null)::int as target_count, 2 - (range1 is null)::int + (range2 is null)::int as legacy from ls")
def leaf_target_count(spark, d):
    return leaf_shots(spark, d).select("scan_id", "seq", leaf.target_count().alias("target_count"), leaf.target_count(True).alias("legacy"))


@R.add("leaf_angles", f"with {LEAF}, {LEAF_ANGLES} select scan_id, seq, {r6s('zenith', 'zenith')}, {r6s('azimuth', 'azimuth')} from la")
def leaf_angles(spark, d):
    return leaf.angles(leaf_shots(spark, d), F.col("nsteps")).select("scan_id", "seq", r6("zenith", "zenith"), r6("azimuth", "azimuth"))


@R.add("leaf_heights", f"with {LEAF_GEO} select scan_id, seq, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("x1", "y1", "z1", "h1", "x2", "y2", "z2", "h2")) + " from lg")
def leaf_heights(spark, d):
    return leaf_geometry(spark, d).select("scan_id", "seq", *[r6(c, c) for c in ("x1", "y1", "z1", "h1", "x2", "y2", "z2", "h2")])


@R.add("leaf_datetime", f"""with {LEAF}, t as (select scan_id, seq, epoch_us(try_strptime(regexp_extract(scan_id, '_(\\d{{8}}-\\d{{6}})Z_', 1), '%Y%m%d-%H%M%S')) + round(sum(coalesce(sample_time, 0)) over (partition by scan_id order by seq rows unbounded preceding) * 1000)::bigint as us from ls)
    select scan_id, seq, us from t""")
def leaf_datetime(spark, d):
    return leaf.row_times(leaf_shots(spark, d)).select("scan_id", "seq", F.unix_micros("row_time").alias("us"))


@R.add("leaf_returns", f"""with {LEAF_GEO} select scan_id, target_index, {r6s('height', 'height')} from (select scan_id, 1 as target_index, h1 as height from lg union all select scan_id, 2, h2 from lg) where height is not null and not isnan(height)""")
def leaf_returns(spark, d):
    return leaf.returns(leaf_geometry(spark, d)).select("scan_id", "target_index", r6("height", "height"))


# one PAI profile per hinge scan: its rings between 50 and 90 degrees as one bin
_CUBE = Cube(hres=1.0, zres=40, ares=360, min_z=50, max_z=90, min_h=0, max_h=30)
_Z0, _Z1 = math.radians(50), math.radians(90)


def scan_profiles(spark, d):
    """scan_id, datetime, hi, pai of every LEAF scan."""
    s = profiles.zenith_window(leaf_geometry(spark, d), 50, 90)
    n = s.groupBy("scan_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = leaf.returns(s).select("scan_id", expr.bin_index(F.col("height"), 1.0).alias("hi")).where(F.col("hi").between(0, 29)).groupBy("scan_id", "hi").agg((F.count(F.lit(1)) * 0.5).alias("w"))
    from pyspark.sql import Window

    up = Window.partitionBy("scan_id").orderBy("hi").rowsBetween(Window.unboundedPreceding, 0)
    dense = n.withColumn("hi", F.explode(F.sequence(F.lit(0), F.lit(29)))).join(t, ["scan_id", "hi"], "left")
    gap = dense.withColumn("pgap", 1 - F.sum(F.coalesce("w", F.lit(0.0))).over(up) / F.col("n"))
    return gap.select("scan_id", leaf.scan_time(F.col("scan_id")).alias("datetime"), "hi", (-1.1 * expr.guarded_ln(F.col("pgap"))).alias("pai"))


_SP = f"""{LEAF_GEO}, w as (select * from lg where zenith >= {_Z0!r}::double and zenith < {_Z1!r}::double), n as (select scan_id, count(*)::double as n from w group by 1),
    t as (select scan_id, hi, count(*) * 0.5::double as w from (select scan_id, {fd('h', 1.0)} as hi from (select scan_id, h1 as h from w where h1 is not null union all select scan_id, h2 from w where h2 is not null)) where hi between 0 and 29 group by all),
    g as (select scan_id, hi, 1 - sum(coalesce(w, 0)) over (partition by scan_id order by hi rows unbounded preceding) / n as pgap from (select * from n, (select unnest(range(30))::int as hi)) left join t using (scan_id, hi)),
    sp as (select scan_id, try_strptime(regexp_extract(scan_id, '_(\\d{{8}}-\\d{{6}})Z_', 1), '%Y%m%d-%H%M%S') as datetime, hi, -1.1::double * (case when pgap > 0 then ln(pgap) else {expr.LOG_FLOOR!r}::double end) as pai from g)"""


def _start(df):
    return df.agg(F.min("datetime").alias("start"))


@R.add("daily_pai_grid", f"""with {_SP}, s0 as (select min(datetime) as start from sp) select floor((epoch(datetime) - epoch(start)) / 86400)::int as x, hi as y, {r6s('avg(pai)', 'value')}, count(pai) as cnt from sp, s0 where pai is not null group by all""")
def daily_pai_grid(spark, d):
    p = scan_profiles(spark, d)
    return series.period_grid(p.crossJoin(_start(p)), F.col("start"), value="pai").select("x", "y", r6("value", "value"), "cnt")


@R.add("weekly_pavd_grid", f"""with {_SP}, s0 as (select min(datetime) as start from sp),
    pv as (select *, case when lag(pai) over w is null then lead(pai) over w - pai when lead(pai) over w is null then pai - lag(pai) over w else (lead(pai) over w - lag(pai) over w) / 2 end as pavd from sp window w as (partition by scan_id order by hi))
    select floor(floor((epoch(datetime) - epoch(start)) / 86400) / 7)::int as x, hi as y, {r6s('avg(pavd)', 'value')}, count(pavd) as cnt from pv, s0 group by all""")
def weekly_pavd_grid(spark, d):
    p = scan_profiles(spark, d)
    v = profiles.pavd(p, 1.0, by=["scan_id"])
    return series.period_grid(v.crossJoin(_start(p)), F.col("start"), days=7, value="pavd").select("x", "y", r6("value", "value"), "cnt")


@R.add("scan_hours", "select hour(datetime) as hour, count(*) as n from leaf_files group by 1 having count(*) > 1")
def scan_hours(spark, d):
    return series.scan_hours(table(spark, d, "leaf_files"))


_STACKED = f"""{LEAF_GEO}, c as (select scan_id, {fd('zenith', math.radians(10))} as y, {fd('azimuth', math.radians(10))} as x, range1 as v from lg where range1 is not null),
    sk as (select scan_id, y, x, min(v) as value from c where y between 0 and 18 and x between 0 and 36 group by all)"""


def hemi_stack(spark, d):
    """scan_id, y, x, value: nearest range per 10 degree cell of each scan."""
    res, rows, cols = grids.spherical_shape(10.0)
    g = leaf_geometry(spark, d).where("range1 is not null").select("scan_id", expr.bin_index(F.col("zenith"), res).alias("y"), expr.bin_index(F.col("azimuth"), res).alias("x"), "range1")
    return g.where(F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)).groupBy("scan_id", "y", "x").agg(F.min("range1").alias("value"))


@R.add("leaf_std_grid", f"with {_STACKED} select y, x, {r6s('stddev_pop(value)', 'std')}, count(*) as n from sk group by y, x having count(*) > 2")
def leaf_std_grid(spark, d):
    return series.cell_std(hemi_stack(spark, d), ["y", "x"]).select("y", "x", r6("std", "std"), "n")


@R.add("leaf_persistence", f"with {_STACKED} select y, x, case when stddev_pop(value) > 0.5 then 0 else 1 end as label from sk group by y, x having count(*) > 2")
def leaf_persistence(spark, d):
    s = series.cell_std(hemi_stack(spark, d), ["y", "x"])
    return s.select("y", "x", series.persistence(F.col("std")).alias("label"))


@R.add("leaf_change", f"""with recursive {_STACKED}, f as (select min(scan_id) as first from sk), o as (select y, x, scan_id, value, row_number() over (partition by y, x order by scan_id) as i from sk),
    walk as (select y, x, i, value as ref, (scan_id > (select first from f))::int as n from o where i = 1
        union all select o.y, o.x, o.i, case when abs(o.value - walk.ref) > 0.5 then o.value else walk.ref end, walk.n + case when o.value > walk.ref + 0.5::double then -1 when o.value < walk.ref - 0.5::double then 1 else 0 end
        from walk join o on o.y = walk.y and o.x = walk.x and o.i = walk.i + 1)
    select y, x, arg_max(n, i)::int as change from walk group by y, x""")
def leaf_change(spark, d):
    return series.interception_change(hemi_stack(spark, d), ["y", "x"], "scan_id")


_TOP = 29


def _hour_day(p, start):
    return p.crossJoin(start).select(F.hour("datetime").alias("hour"), series.day_index(F.col("datetime"), F.col("start")).alias("day"), "hi", "pai")


_HOUR_GRID = f"""{_SP}, s0 as (select min(datetime) as start, max(datetime) as stop from sp),
    hd as (select hour(datetime) as hour, floor((epoch(datetime) - epoch(start)) / 86400)::int as day, hi, pai from sp, s0),
    hs_ as (select hour from hd where hi = 0 group by 1 having count(*) > 1), gh as (select hour, day, hi, avg(pai) as pai, count(pai) as cnt from hd semi join hs_ using (hour) group by all)"""


@R.add("daily_pai_by_hour", f"""with {_HOUR_GRID} select hour, day, hi, {r6s('pai', 'pai')}, cnt from gh where (hour, day) in (select (hour, day) from gh where hi = {_TOP} and pai > 0)""")
def daily_pai_by_hour(spark, d):
    """Mean PAI by scan hour, day and layer; hours with one scan, and days without
    a total PAI above 0, are left out."""
    p = written(scan_profiles(spark, d), "scans")
    hours = series.scan_hours(p.where("hi = 0")).select("hour")
    grid = _hour_day(p, _start(p)).join(hours, "hour", "left_semi").groupBy("hour", "day", "hi").agg(F.avg("pai").alias("pai"), F.count("pai").alias("cnt"))
    good = grid.where((F.col("hi") == _TOP) & (F.col("pai") > 0)).select("hour", "day")
    return grid.join(good, ["hour", "day"], "left_semi").select("hour", "day", "hi", r6("pai", "pai"), "cnt")


_EVENTS = "ev as (select user_id, ts::date as day, avg(value) as value from events where value is not null and not isnan(value) group by all)"


def _daily_events(spark, d):
    e = table(spark, d, "events").where("value is not null and not isnan(value)")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))


@R.add("day_spine", f"""with {_EVENTS}, e as (select user_id, min(day) as a, max(day) as b from ev group by 1), s as (select user_id, unnest(generate_series(a, b, interval 1 day))::date as day from e)
    select user_id, (day - date '1970-01-01')::int as day_number, {r6s('value', 'value')} from s left join ev using (user_id, day)""")
def day_spine(spark, d):
    s = series.day_spine(_daily_events(spark, d), "user_id", "day", "value")
    return s.select("user_id", F.unix_date("day").alias("day_number"), r6("value", "value"))


@R.add("bisquare_weights", f"""with {_EVENTS}, m as (select user_id, median(value) as m from ev group by 1), r as (select user_id, day, value - m as resid from ev join m using (user_id)),
    rm as (select user_id, median(resid) as rm from r group by 1), mad as (select user_id, median(abs(resid - rm)) as mad from r join rm using (user_id) group by 1),
    u as (select user_id, day, abs(resid / nullif(1.4826::double * mad, 0)) / {float(np.sqrt(1 - 0.1))!r}::double / 4.685::double as u from r join mad using (user_id))
    select user_id, (day - date '1970-01-01')::int as day_number, round(case when u < 1 then pow(1 - u * u, 2) when u is not null then 0 end, 6) + 0.0 as weight from u""")
def bisquare_weights(spark, d):
    e = _daily_events(spark, d)
    m = e.groupBy("user_id").agg(F.median("value").alias("m"))
    r = e.join(m, "user_id").withColumn("resid", F.col("value") - F.col("m"))
    w = series.bisquare_weights(r, ["user_id"], "resid", 0.1)
    return w.select("user_id", F.unix_date("day").alias("day_number"), r6("weight", "weight"))


_DCT = f"case when {{k}} = 0 then sqrt(1.0::double / 64) else sqrt(2.0::double / 64) * cos({math.pi!r}::double * (2 * {{i}} + 1) * {{k}} / 128) end"


@R.add("dct2", f"""with l as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), k as (select unnest(range(64)) as k)
    select vec_id, k::int as k, round(sum(v * ({_DCT.format(k='k', i='i')})), 6) + 0.0 as coef from l, k group by vec_id, k""")
def dct2(spark, d):
    return series.dct(table(spark, d, "embeddings"), "vec_id", "embedding", 64).select("vec_id", "k", r6("coef", "coef"))


@R.add("idct2", f"""with l as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), k as (select unnest(range(64)) as k)
    select vec_id, k::int as k, round(sum(v * ({_DCT.format(k='i', i='k')})), 6) + 0.0 as coef from l, k group by vec_id, k""")
def idct2(spark, d):
    return series.dct(table(spark, d, "embeddings"), "vec_id", "embedding", 64, inverse=True).select("vec_id", "k", r6("coef", "coef"))


@R.add("double_sigmoid", f"""select x, round(2 - 5 * (1 / (1 + exp(0.1::double * (x - 20))) + 1 / (1 + exp(-0.1::double * (x - 200))) - 1), 6) + 0.0 as y from (select unnest(range(366))::double as x)""")
def double_sigmoid(spark, d):
    x = spark.range(366).select(F.col("id").cast("double").alias("x"))
    return x.select("x", r6(expr.double_sigmoid([2, 5, 0.1, 20, 0.1, 200], F.col("x")), "y"))


def _smooth_sql(source: str, p: float, max_k: int) -> str:
    """CTE `sm` (id, part, j, value, smooth, weight, good) of the series in
    `source` (id, part, ys: a list, NULL where missing) smoothed with the penalty
    10^p: the smoothing matrix of each length, and one recursion per series."""
    def norm(v):
        return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"

    def minus(a, b):
        return f"list_transform(list_zip({a}, {b}), lambda q: q[1] - q[2])"

    root = math.sqrt(1 + 16 * 10.0**p)
    spread = 1.4826 * math.sqrt(1 - math.sqrt(1 + root) / math.sqrt(2) / root)
    pi = f"{math.pi!r}::double"
    return f"""src as ({source}), ns as (select distinct len(ys) as n from src),
    kk as (select n, unnest(range(n)) as k from ns), gg as (select n, k, (case when k = 0 then 1.0::double else 2.0::double end) / n / (1 + {10.0**p!r}::double * pow(2 * cos({pi} * k / n) - 2, 2)) as g from kk),
    mx as (select n, list(r order by i) as m from (select n, i, list(v order by j) as r from (select a.n, a.k as i, b.k as j, sum(g * cos({pi} * (2 * a.k + 1) * gg.k / (2 * a.n)) * cos({pi} * (2 * b.k + 1) * gg.k / (2 * a.n))) as v
        from kk a join kk b on a.n = b.n join gg on gg.n = a.n group by all) group by all) group by n),
    st as (select id, part, n, list_transform(ys, lambda x: coalesce(x, 0.0::double)) as y, list_transform(ys, lambda x: case when x is null then 0.0::double else 1.0::double end) as w,
            list_transform(ys, lambda x: coalesce(x, 0.0::double)) as z, 0 as k from (select *, len(ys) as n from src) where len(list_filter(ys, lambda x: x is not null)) > 0
        union all select id, part, n, y, case when rest then list_transform(u, lambda x: case when x < 1 then pow(1 - x * x, 2) when x is null then 1.0::double else 0.0::double end) else w end, z2, k + rest::int
        from (select *, list_transform(r, lambda x: abs(x) / nullif({spread!r}::double * list_median(list_transform(r, lambda v: abs(v - list_median(r)))), 0) / 4.685::double) as u
            from (select *, not ({norm(minus('z', 'z2'))} > 1e-5::double * {norm('z2')}) as rest, {minus('y', 'z2')} as r
                from (select * exclude (m, v), list_transform(m, lambda row: list_dot_product(row, v)) as z2
                    from (select st.*, m, list_transform(list_zip(w, y, z), lambda q: q[1] * (q[2] - q[3]) + q[3]) as v from st join mx using (n) where k < {max_k}))))),
    sm as (select id, part, unnest(range(n))::int as j, unnest(y) as value, unnest(z) as smooth, unnest(w) as weight from st where k = {max_k})"""


_SERIES = "select vec_id as id, 0 as part, list_transform(embedding, lambda x: case when x::double + 1 > 0 then x::double + 1 end) as ys from embeddings"


@R.add("rsmooth", f"""with recursive {_smooth_sql(_SERIES, 1.0, 3)} select id as vec_id, j as i, {r6s('case when value > 0 then value end', 'value')}, {r6s('smooth', 'smooth')}, {r6s('weight', 'weight')},
    value > 0 and weight > 0 and not (value - smooth < -1) as good, true as settled from sm""")
def rsmooth(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    s = series.smooth_series(e.withColumn("v", F.col("v").cast("double") + 1.0), "vec_id", "i", "v", p=1.0, max_k=3)
    return s.select("vec_id", "i", *[r6(expr.clean(F.col(c)), c) for c in ("value", "smooth", "weight")], "good", "settled")


_DAYS = f"""days as (select user_id, min(day) as a, max(day) as b from ev group by 1), spine as (select user_id, unnest(generate_series(a, b, interval 1 day))::date as day from days),
    full_ as (select user_id, day, value, row_number() over (partition by user_id order by day ) - 1 as pos from spine left join ev using (user_id, day))"""
_CUT = [10, 20]
_PART = f"case when pos < {_CUT[0]} then 0 when pos < {_CUT[1]} then 1 else 2 end"
_PARTS = f"select user_id as id, {_PART} as part, list(case when value > 0 then value end order by pos) as ys from full_ group by all"


@R.add("quality_flag_fixed", f"""with recursive {_EVENTS}, {_DAYS}, {_smooth_sql(_PARTS, 1.0, 6)} select user_id, (day - date '1970-01-01')::int as day_number, {r6s('sm.smooth', 'smooth')},
    coalesce(full_.value > 0 and sm.weight > 0 and not (full_.value - sm.smooth < -1), false) as good from full_ left join sm on sm.id = user_id and sm.part = {_PART} and sm.j = pos - part * 10""")
def quality_flag_fixed(spark, d):
    """The flags with one penalty given for all segments."""
    s = series.day_spine(_daily_events(spark, d), "user_id", "day", "value")
    f = series.smooth_series(s, "user_id", "day", "value", p=1.0, segments=_CUT)
    return f.select("user_id", F.unix_date("day").alias("day_number"), r6(expr.clean(F.col("smooth")), "smooth"), "good")


@R.add("quality_flag")
def quality_flag(spark, d):
    s = series.day_spine(_daily_events(spark, d), "user_id", "day", "value")
    return series.smooth_series(s, "user_id", "day", "value", p=[1.0, None, 1.0], segments=_CUT).select("user_id", "day", "value", "smooth", "good", "settled")


@R.add("phenology_fit")
def phenology_fit(spark, d):
    e = _daily_events(spark, d).withColumn("n", F.unix_date("day") - F.lit(19723))
    return series.phenology(e, "user_id", "n", "value")


QUERIES, SQL = R.queries, R.sql

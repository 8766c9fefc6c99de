"""Queries over the LEAF and point tables for large data sets (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfold.operators import badrows, compaction, drift, percentiles, regrid
from gapfold.operators.leaf_layout import COLUMNS_NEW
from gapfold.sources.tables import table


def p1_found(spark, d):
    s = compaction.packing_session(spark, compaction.Packing())
    return compaction.surplus_records(table(s, d, "leaf_fragments"))


def p1_compact(spark, d):
    s = compaction.packing_session(spark, compaction.Packing())
    return compaction.compaction_report(table(s, d, "leaf_fragments"))


def p2_found(spark, d):
    c = drift.change_log(table(spark, d, "leaf_lines"), table(spark, d, "leaf_files"))
    return c.select("serial_number", "scan_count", "field_name", "change_kind")


def p2_unified(spark, d):
    return drift.unified_rows(table(spark, d, "leaf_lines"))


def p2_unified_values(spark, d):
    """The union table's LEAF fields as numbers, and how many of them a row has;
    whatever the union types are."""
    u = drift.unified_rows(table(spark, d, "leaf_lines"))
    number = [F.col(c).cast("string").try_cast("double").alias(c) for c in COLUMNS_NEW]
    return u.select("file_id", "line_no", *number, sum((F.col(c).isNotNull().cast("int") for c in COLUMNS_NEW), F.lit(0)).alias("present"))


def p3_percentiles(spark, d):
    return percentiles.point_percentiles(table(spark, d, "points_rdb"))


def p3_combined(spark, d):
    return percentiles.combined_percentiles(table(spark, d, "points_rdb"))


def p3_combined_rank(spark, d):
    """The stated rank errors of p3_combined hold."""
    return percentiles.combined_ranks(table(spark, d, "points_rdb"))


def p4_found(spark, d):
    return regrid.missing_slots(table(spark, d, "leaf_shots"))


def p4_grid(spark, d):
    g = regrid.leaf_grid(table(spark, d, "leaf_shots"))
    return g.withColumn("value", F.round("value", 6) + F.lit(0.0))


def p5_found(spark, d):
    return badrows.bad_rows(table(spark, d, "leaf_lines")).select("file_id", "line_no", "reason")


def p5_rows(spark, d):
    return badrows.good_rows(table(spark, d, "leaf_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_compact, p2_found, p2_unified, p2_unified_values, p3_percentiles, p3_combined, p3_combined_rank, p4_found, p4_grid, p5_found, p5_rows)}

_CLEAN = r"""trim(regexp_replace(trim(f, ' ' || chr(9) || chr(13)), '^"([^"]*)"$', '\1'), ' ' || chr(9) || chr(13))"""
_RECORDS = r"""
lines as (select fragment_id, serial_number, scan_count, unnest(string_split_regex(body, '\r?\n')) as line, generate_subscripts(string_split_regex(body, '\r?\n'), 1) as line_no from leaf_fragments),
rec as (select fragment_id, line_no, serial_number, scan_count, line, list_transform(string_split(line, ','), lambda f: coalesce((try_cast({clean} as double) + 0.0)::varchar, '''' || {clean})) as k
        from lines where not starts_with(line, '#') and trim(line, ' ' || chr(9) || chr(13)) <> ''),
ranked as (select *, row_number() over (partition by serial_number, scan_count, k order by fragment_id, line_no) as rn from rec)""".replace("{clean}", _CLEAN)

_LAYOUT = r"""
body as (select file_id, line_no, regexp_replace(line_text, '\r$', '') as t from leaf_lines where line_text is not null and not starts_with(line_text, '#') and trim(line_text, ' ' || chr(9) || chr(13)) <> ''),
first_body as (select file_id, min(line_no) as fb from body group by 1),
head as (select l.file_id, l.line_no, l.line_text as h from leaf_lines l left join first_body b using (file_id) where starts_with(l.line_text, '#') and (b.fb is null or l.line_no < b.fb)),
named as (select file_id, arg_min(names, line_no) as names from (
    select file_id, line_no, list_filter(list_transform(string_split_regex(regexp_replace(h, '^#[ \t]*[^,;|\t:]*:', ''), '[,;|\t]'), lambda x: trim(x)), lambda x: x <> '') as names from head where h like '%:%') where list_contains(names, 'sample_count') and list_contains(names, 'sample_time') group by 1),
fw as (select file_id, min(try_cast(regexp_extract(h, 'Firmware ver\.: *([0-9.]+)', 1) as double)) as v from head where h like '%Firmware ver%' group by 1),
ids as (select distinct file_id from leaf_lines),
layout as (select i.file_id, coalesce(n.names, case when fw.v >= 4.11 then ['sample_count','scan_encoder','rotary_encoder','range1','intensity1','range2','intensity2','sample_time']
    else ['sample_count','scan_encoder','rotary_encoder','range1','intensity1','range2','sample_time'] end) as names from ids i left join named n using (file_id) left join fw using (file_id)),
parsed as (select b.file_id, b.line_no, l.names, regexp_full_match(t, '([^",]*|[ \t]*"[^"]*"[ \t]*)(,([^",]*|[ \t]*"[^"]*"[ \t]*))*') as quoted_well,
    list_transform(regexp_extract_all(t || ',', '([^",]*|[ \t]*"[^"]*"[ \t]*),'), lambda x: trim(trim(trim(substr(x, 1, length(x) - 1), ' ' || chr(9)), '"'), ' ' || chr(9))) as f
    from body b join layout l using (file_id)),
located as (select *, f[list_position(names, 'sample_count')] as c, f[list_position(names, 'sample_time')] as s from parsed),
judged as (select file_id, line_no, names, f, case when not quoted_well then 'quoting' when len(f) <> len(names) then 'columns'
    when not regexp_full_match(c, '\+?[0-9]+') or coalesce(try_cast(c as hugeint), 2147483648) > 2147483647 then 'value'
    when not regexp_full_match(s, '\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') or not isfinite(coalesce(try_cast(s as double), 'inf'::double)) then 'value' end as reason from located)"""

_CHANGES = r"""
placed as (select file_id, names, list_filter(range(1, len(names) + 1), lambda i: regexp_matches(lower(names[i]), 'enc') and not regexp_matches(lower(names[i]), 'rotary'))[1] as e,
    list_filter(range(1, len(names) + 1), lambda i: regexp_matches(lower(names[i]), 'int|amp') and regexp_matches(lower(names[i]), '2|second'))[1] as i from layout),
per as (select file_id, unnest(['scan_encoder', 'intensity2']) as field_name, unnest([names[e], names[i]]) as nm, unnest([e, i]) as p from placed),
vals as (select p.file_id, p.field_name, j.f[p.p] as v from per p join judged j using (file_id) where j.reason is null and p.p is not null),
types as (select file_id, field_name, max(case when not regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') then 2 when contains(v, '.') then 1 else 0 end) as ty
    from vals where v <> '' and coalesce(try_cast(v as double), 0) <> -1 group by 1, 2),
files as (select file_name, arg_min(struct_pack(file_id := file_id, serial_number := serial_number, scan_count := scan_count, datetime := datetime), file_id) as x from leaf_files group by 1),
seq as (select x.serial_number as serial_number, x.scan_count as scan_count, field_name, nm, coalesce(ty, 0) as ty, lag(nm) over w as pn, lag(coalesce(ty, 0)) over w as pt, lag(true) over w as here
    from files join per on per.file_id = x.file_id left join types using (file_id, field_name) window w as (partition by x.serial_number, field_name order by x.datetime, file_name)),
changes as (select serial_number, scan_count, field_name, unnest([case when pn is null and nm is not null then 'added' when pn is not null and nm is null then 'removed' when pn <> nm then 'renamed' end,
    case when pn is not null and nm is not null and pt <> ty then 'retyped' end]) as change_kind from seq where here)"""

def _secant(a: str, b: str) -> str:
    return f"(({b}v - {a}v) / {_step(a, b)})"


def _step(a: str, b: str) -> str:
    return f"({b}s - {a}s + ({b}o - {a}o))"


def _inner(p: str, a: str, b: str) -> str:
    h0, h1, d0, d1 = _step(p, a), _step(a, b), _secant(p, a), _secant(a, b)
    return f"case when {d0} * {d1} <= 0 then 0 else ((2 * {h1} + {h0}) + ({h1} + 2 * {h0})) / ((2 * {h1} + {h0}) / nullif({d0}, 0) + ({h1} + 2 * {h0}) / nullif({d1}, 0)) end"


def _end(a: str, b: str, c: str) -> str:
    h0, h1, d0, d1 = f"abs({_step(a, b)})", f"abs({_step(b, c)})", _secant(a, b), _secant(b, c)
    d = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"case when {d} * {d0} <= 0 then 0 when {d0} * {d1} <= 0 and abs({d}) > 3 * abs({d0}) then 3 * {d0} else {d} end"


_GRID = f"""with k as (select scan_id, s, count(*) as n, avg(sec - s) as o, avg(range1) as v from (select scan_id, range1, epoch_us(datetime) / 1e6::double as sec, (floor(epoch_us(datetime) / 1e6::double / 10) * 10)::bigint as s
        from leaf_shots where datetime is not null and range1 is not null and not isnan(range1) and range1 <> -1 and range1 <= 120 and intensity1 > 0) group by all),
    w as (select scan_id, n, s as a_s, o as a_o, v as a_v, {", ".join(f"{f}({x}{i}) over (partition by scan_id order by s) as {k}_{x}" for k, f, i in (("p", "lag", ""), ("b", "lead", ""), ("c", "lead", ", 2")) for x in "sov")} from k),
    m as (select *, p_s is not null and a_s - p_s <= 60 as has_p, c_s is not null and c_s - b_s <= 60 as has_c from w),
    d as (select *, case when has_p then {_inner("p_", "a_", "b_")} when has_c then {_end("a_", "b_", "c_")} else {_secant("a_", "b_")} end as da,
        case when has_c then {_inner("a_", "b_", "c_")} when has_p then {_end("b_", "a_", "p_")} else {_secant("a_", "b_")} end as db, {_step("a_", "b_")} as h from m),
    g as (select *, unnest(generate_series(a_s, coalesce(b_s - 10, a_s), 10)) as slot_epoch from d),
    e as (select *, (slot_epoch - a_s + (5.0::double - a_o)) / h as u from g)
    select scan_id, slot_epoch, case when slot_epoch = a_s then n else 0 end as n_readings,
        round(case when slot_epoch = a_s then a_v when b_s - a_s <= 60 then a_v * (2 * u * u * u - 3 * u * u + 1) + h * da * (u * u * u - 2 * u * u + u) + b_v * (3 * u * u - 2 * u * u * u) + h * db * (u * u * u - u * u) end, 6) + 0.0 as value,
        case when slot_epoch = a_s then 'observed' when b_s - a_s <= 60 then 'filled' else 'gap' end as status from e"""

_ROWS = r"""pl as (select file_id, names, list_filter(range(1, len(names) + 1), lambda i: regexp_matches(lower(names[i]), 'enc') and not regexp_matches(lower(names[i]), 'rotary'))[1] as e,
        list_filter(range(1, len(names) + 1), lambda i: regexp_matches(lower(names[i]), 'int|amp') and regexp_matches(lower(names[i]), '2|second'))[1] as i from layout),
    x as (select j.*, pl.e, pl.i from judged j join pl using (file_id) where reason is null)
    select file_id, line_no, f[list_position(names, 'sample_count')]::int as sample_count, nullif(try_cast(f[e] as double), -1) as scan_encoder, nullif(try_cast(f[list_position(names, 'rotary_encoder')] as double), -1) as rotary_encoder,
        nullif(try_cast(f[list_position(names, 'range1')] as double), -1) as range1, trunc(nullif(try_cast(f[list_position(names, 'intensity1')] as double), -1))::int as intensity1,
        nullif(try_cast(f[list_position(names, 'range2')] as double), -1) as range2, trunc(nullif(try_cast(f[i] as double), -1))::int as intensity2, f[list_position(names, 'sample_time')]::double as sample_time from x"""

_FIELD = {c: f"f[list_position(names, '{c}')]" for c in COLUMNS_NEW} | {"scan_encoder": "f[e]", "intensity2": "f[i]"}
_PRESENT = {c: f"case when {v} <> '' and not regexp_full_match({v}, '-0*1([.]0*)?') then {v} end" for c, v in _FIELD.items()}
_UNIFIED = (_ROWS[:_ROWS.index("    select file_id")] + "    select file_id, line_no, " + ", ".join(f"try_cast({v} as double) as {c}" for c, v in _PRESENT.items())
            + ", " + " + ".join(f"({v} is not null)::int" for v in _PRESENT.values()) + " as present from x")

SQL = {
    "p1_found": f"with {_RECORDS} select fragment_id, line_no from ranked where rn > 1",
    "p1_compact": f"with {_RECORDS} select (select count(*) from leaf_fragments) as files_in, (select sum(strlen(body)) from leaf_fragments)::bigint as bytes_in, count(*) as records, true as well_sized from ranked where rn = 1",
    "p2_found": f"with {_LAYOUT}, {_CHANGES} select serial_number, scan_count, field_name, change_kind from changes where change_kind is not null",
    "p2_unified_values": f"with {_LAYOUT}, {_UNIFIED}",
    "p3_percentiles": """with l as (unpivot (select scan_id, cast(null as date) as day, 0 as level, x, y, z from points_rdb union all select scan_id, loaded_at::date, 1, x, y, z from points_rdb) on x, y, z into name col value v),
        o as (select *, row_number() over (partition by level, scan_id, day, col order by v) as rn, count(*) over (partition by level, scan_id, day, col) as n from l where not isnan(v))
        select scan_id, day, level, col, n, permille, v + 0.0 as value, 0.0::double as rank_error from o, (select unnest([10, 50, 250, 500, 750, 950, 990]) as permille) where rn = greatest(1, (permille * n + 999) // 1000)""",
    "p3_combined_rank": """with l as (unpivot (select scan_id, x, y, z from points_rdb) on x, y, z into name col value v)
        select scan_id, col, count(*) as n, permille, true as within from l, (select unnest([10, 50, 250, 500, 750, 950, 990]) as permille) where not isnan(v) group by all""",
    "p4_found": """with u as (select distinct scan_id, (floor(epoch(datetime) / 10) * 10)::bigint as s from leaf_shots where datetime is not null and range1 is not null and not isnan(range1) and range1 <> -1 and range1 <= 120 and intensity1 > 0),
        a as (select scan_id, unnest(generate_series(min(s), max(s), 10)) as s from u group by scan_id) select scan_id, s as slot_epoch from (select * from a except select * from u)""",
    "p4_grid": _GRID,
    "p5_rows": f"with {_LAYOUT}, {_ROWS}",
    "p5_found": f"with {_LAYOUT} select file_id, line_no, reason from judged where reason is not null",
}

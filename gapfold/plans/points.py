"""Queries over scans, pulses and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfold.functions import expr, predicate
from gapfold.operators import pulses
from gapfold.plans.common import KEY, MOVED, PTS, PUL, Registry, fd, moved, points, r6, r6s, shots
from gapfold.session import fresh_path
from gapfold.sources import transforms
from gapfold.sources.tables import table

R = Registry()
_MATRIX = ["r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22", "tx", "ty", "tz"]


@R.add("scan_pulses", "select scan_id, pulse_id, scanline, scanline_idx, target_count from pulses")
def scan_pulses(spark, d):
    return table(spark, d, "pulses").select("scan_id", "pulse_id", "scanline", "scanline_idx", "target_count")


@R.add("scan_points", f"with {PTS} select scan_id, scanline, scanline_idx, target_index, riegl_id, x, y, z from pts")
def scan_points(spark, d):
    return points(spark, d).select("scan_id", "scanline", "scanline_idx", "target_index", "riegl_id", "x", "y", "z")


@R.add("scan_points_rdb", "select scan_id, riegl_id, range, reflectance, classification from points_rdb")
def scan_points_rdb(spark, d):
    return table(spark, d, "points_rdb").select("scan_id", "riegl_id", "range", "reflectance", "classification")


@R.add("derive_range", f"with {PTS} select scan_id, riegl_id, {r6s('sqrt(x * x + y * y + z * z)', 'range')} from pts")
def derive_range(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points(spark, d).select("scan_id", "riegl_id", r6(F.sqrt(x * x + y * y + z * z), "range"))


@R.add("scan_meta", "select * from (unpivot (select scan_id, kind, path, tx::varchar as tx, ty::varchar as ty, tz::varchar as tz, pitch::varchar as pitch, roll::varchar as roll, yaw::varchar as yaw from scans) on kind, path, tx, ty, tz, pitch, roll, yaw into name key value value)")
def scan_meta(spark, d):
    s = table(spark, d, "scans")
    cols = ["kind", "path", "tx", "ty", "tz", "pitch", "roll", "yaw"]
    return s.unpivot("scan_id", [F.col(c).cast("string").alias(c) for c in cols], "key", "value").where("value is not null")


@R.add("meta_json_get", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def meta_json_get(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.add("transform_load", "select scan_id, " + ", ".join(_MATRIX) + " from scans")
def transform_load(spark, d):
    """The transforms from their files."""
    path = fresh_path(spark, "transforms")
    transforms.write_transforms(table(spark, d, "scans"), path)
    return transforms.read_transforms(spark, path).select("scan_id", *_MATRIX)


def _rotation_sql(columns: str) -> str:
    return f"""with a as (select scan_id, radians(pitch) as p, radians(roll) as r, radians(coalesce(case when not isnan(yaw) then yaw end, 0)) as w from scans),
        m as (select scan_id, cos(w) * cos(p) as m00, cos(w) * sin(p) * sin(r) - sin(w) * cos(r) as m01, cos(w) * sin(p) * cos(r) + sin(w) * sin(r) as m02,
            sin(w) * cos(p) as m10, sin(w) * sin(p) * sin(r) + cos(w) * cos(r) as m11, sin(w) * sin(p) * cos(r) - cos(w) * sin(r) as m12,
            -sin(p) as m20, cos(p) * sin(r) as m21, cos(p) * cos(r) as m22 from a) select {columns} from m"""


_NINE = [f"m{i}{j}" for i in range(3) for j in range(3)]


@R.add("rotation_matrix", _rotation_sql("scan_id, " + ", ".join(r6s(c, c) for c in _NINE)))
def rotation_matrix(spark, d):
    m = expr.rotation_matrix(F.col("pitch"), F.col("roll"), F.col("yaw"))
    return table(spark, d, "scans").select("scan_id", *[r6(c, k) for k, c in m.items()])


_DET = "m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)"


@R.add("transform_pose", _rotation_sql(f"scan_id, {r6s('m00 + m11 + m22', 'trace')}, {r6s(_DET, 'det')}"))
def transform_pose(spark, d):
    m = expr.rotation_matrix(F.col("pitch"), F.col("roll"), F.col("yaw"))
    path = fresh_path(spark, "poses")
    transforms.write_poses(table(spark, d, "scans"), path)
    s = transforms.read_poses(spark, path).select("scan_id", *[c.alias(k) for k, c in m.items()])
    return s.select("scan_id", r6(F.expr("m00 + m11 + m22"), "trace"), r6(F.expr(_DET), "det"))


@R.add("point_filter", "select scan_id, riegl_id, reflectance, range from points_rdb where reflectance > -15 and not isnan(reflectance) and range < 30 and classification != 4")
def point_filter(spark, d):
    p = table(spark, d, "points_rdb")
    return predicate.where(p, ["reflectance > -15", "(range < 30)", "classification != 4"]).select("scan_id", "riegl_id", "reflectance", "range")


@R.add("reindex_targets", f"""with {PTS} select scan_id, riegl_id, row_number() over (partition by {KEY} order by target_index, riegl_id)::int as target_index,
    count(*) over (partition by {KEY})::int as target_count from pts where reflectance > -20 and not isnan(reflectance)""")
def reindex_targets(spark, d):
    return pulses.reindex_targets(points(spark, d), "reflectance > -20").select("scan_id", "riegl_id", F.col("target_index").cast("int").alias("target_index"), "target_count")


@R.add("pulse_attr_on_points", f"with {PTS}, {PUL} select p.scan_id, p.riegl_id, u.pulse_id as pulse_pulse_id, u.zenith as pulse_zenith, u.prism_facet as pulse_prism_facet from pts p join pul u using ({KEY})")
def pulse_attr_on_points(spark, d):
    j = pulses.attach_pulses(points(spark, d), shots(spark, d), ["pulse_id", "zenith", "prism_facet"])
    return j.select("scan_id", "riegl_id", "pulse_pulse_id", "pulse_zenith", "pulse_prism_facet")


@R.add("pulse_target_count", f"""with {PTS}, {PUL}, n as (select {KEY}, count(*) as n from pts where reflectance > -20 and not isnan(reflectance) group by all)
    select scan_id, pulse_id, coalesce(n, 0)::int as target_count from pul left join n using ({KEY})""")
def pulse_target_count(spark, d):
    kept = predicate.where(points(spark, d), "reflectance > -20")
    return pulses.pulse_target_counts(shots(spark, d), kept).select("scan_id", "pulse_id", "target_count")


@R.add("points_by_pulse", f"""with {PTS}, {PUL}, a as (select {KEY}, list(range order by target_index, range) as ranges from pts group by all)
    select scan_id, pulse_id, len(coalesce(ranges, []))::int as n, array_to_string(coalesce(ranges, []), ',') as ranges from pul left join a using ({KEY})""")
def points_by_pulse(spark, d):
    j = pulses.points_by_pulse(shots(spark, d), points(spark, d), ["range"])
    return j.select("scan_id", "pulse_id", F.size("returns").alias("n"), F.array_join(F.col("returns.range"), ",").alias("ranges"))


@R.add("rdb_points_by_pulse", f"""with {PTS}, {PUL} select u.scan_id, u.pulse_id, p.riegl_id, p.target_index, p.reflectance from pul u left join pts p using ({KEY})""")
def rdb_points_by_pulse(spark, d):
    p = points(spark, d).select(*pulses.PULSE_KEY, "riegl_id", "target_index", "reflectance")
    return shots(spark, d).select(*pulses.PULSE_KEY, "pulse_id").join(p, pulses.PULSE_KEY, "left").select("scan_id", "pulse_id", "riegl_id", "target_index", "reflectance")


@R.add("scan_stats", """select scan_id, max(scanline) as max_scanline, max(scanline_idx) as max_scanline_idx, max(case when not isnan(range) then range end) as max_range,
    max(target_count) as max_target_count, count(*) as n_points from points_rdb group by 1""")
def scan_stats(spark, d):
    return pulses.scan_stats(table(spark, d, "points_rdb"))


@R.add("apply_transform", f"with {MOVED} select scan_id, riegl_id, x, y, z from tp")
def apply_transform(spark, d):
    return moved(spark, d).select("scan_id", "riegl_id", "x", "y", "z")


@R.add("xyz_to_rza", f"with {MOVED} select scan_id, riegl_id, {r6s('zenith', 'zenith')}, {r6s('azimuth', 'azimuth')} from tp")
def xyz_to_rza(spark, d):
    return moved(spark, d).select("scan_id", "riegl_id", r6("zenith", "zenith"), r6("azimuth", "azimuth"))


@R.add("rza_to_xyz", f"""with {PUL} select scan_id, pulse_id, {r6s('10.0::double * sin(zenith) * sin(azimuth)', 'x')}, {r6s('10.0::double * sin(zenith) * cos(azimuth)', 'y')},
    {r6s('10.0::double * cos(zenith)', 'z')} from pul where zenith is not null and azimuth is not null""")
def rza_to_xyz(spark, d):
    x, y, z = expr.rza_to_xyz(F.lit(10.0), F.col("zenith"), F.col("azimuth"))
    return shots(spark, d).where("zenith is not null and azimuth is not null").select("scan_id", "pulse_id", r6(x, "x"), r6(y, "y"), r6(z, "z"))


@R.add("height_above_plane", f"with {MOVED} select scan_id, riegl_id, {r6s('z - (0.01::double * x + (-0.02)::double * y + 0.5::double)', 'height')} from tp")
def height_above_plane(spark, d):
    return moved(spark, d).select("scan_id", "riegl_id", r6(pulses.height_above_plane((0.5, 0.01, -0.02)), "height"))


@R.add("height_without_plane", f"""with {MOVED} select scan_id, riegl_id, z - (s.tz - 1.5::double) as height, z + (s.tz - 1.5::double) as legacy
    from tp join (select scan_id, tz from scans) s using (scan_id)""")
def height_without_plane(spark, d):
    p = pulses.transformed(points(spark, d), table(spark, d, "scans"), position=True)
    h = lambda old: pulses.height_above_sensor_ground(F.col("tz"), 1.5, old)
    return p.select("scan_id", "riegl_id", h(False).alias("height"), h(True).alias("legacy"))


@R.add("zenith_filter", f"""with {MOVED} select scan_id, riegl_id from tp where zenith >= radians(35::double) and zenith < radians(70::double) and range * sin(zenith) < 20""")
def zenith_filter(spark, d):
    from gapfold.operators.profiles import zenith_window

    return zenith_window(moved(spark, d), 35, 70, 20).select("scan_id", "riegl_id")


@R.add("bin_index", f"with {PTS} select scan_id, riegl_id, {fd('z', 0.1)} as bz, {fd('range', 0.5)} as br, {fd('x', 0.25)} as bx from pts")
def bin_index(spark, d):
    b = lambda c, s: expr.bin_index(F.col(c), s)
    return points(spark, d).select("scan_id", "riegl_id", b("z", 0.1).alias("bz"), b("range", 0.5).alias("br"), b("x", 0.25).alias("bx"))


@R.add("scan_manifest", """select scan_id, kind, path, coalesce(a.n, 0) as n_pulses, coalesce(b.n, 0) as n_points from scans left join (select scan_id, count(*) as n from pulses group by 1) a using (scan_id)
    left join (select scan_id, count(*) as n from points_rdb group by 1) b using (scan_id)""")
def scan_manifest(spark, d):
    """Each scan with its parts: the files a position was zipped from."""
    return transforms.manifest(table(spark, d, "scans"), table(spark, d, "pulses"), table(spark, d, "points_rdb"))


@R.add("points_sorted", "select scan_id, riegl_id, loaded_at from points_rdb order by riegl_id, loaded_at, scan_id")
def points_sorted(spark, d):
    return table(spark, d, "points_rdb").select("scan_id", "riegl_id", "loaded_at").orderBy("riegl_id", "loaded_at", "scan_id")


QUERIES, SQL = R.queries, R.sql

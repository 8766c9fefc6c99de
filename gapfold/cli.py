"""Command line: python -m gapfold.cli COMMAND --data DIR --out DIR ...

The tables scans, pulses, points_rdb (and leaf_shots) are read from the data
directory; grids and voxels are written as Parquet, profiles as CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfold.functions import predicate
from gapfold.operators import grids, ground, leaf, profiles, pulses, voxels
from gapfold.sources import sinks
from gapfold.sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gapfold")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--data", required=True, help="directory of the tables")
        c.add_argument("--out", required=True, help="output directory or file")
        c.add_argument("--scan", nargs="*", help="scans to use (default: all)")
        c.add_argument("-q", "--query", nargs="*", help="filters of returns, such as 'reflectance > -20'")
        return c

    c = command("cartesiangrid", "grid returns over x and y")
    c.add_argument("-a", "--attribute", default="z")
    c.add_argument("-m", "--method", default="MAX", choices=sorted(grids.METHODS))
    c.add_argument("-r", "--resolution", type=float, default=0.5)
    c.add_argument("-e", "--extent", type=float, nargs=2, default=(50, 50))
    c.add_argument("-u", "--ulc", type=float, nargs=2, default=(-25, 25))
    c.add_argument("--plane", action="store_true", help="grid the height above a fitted ground plane")

    c = command("scangrid", "grid returns by scanline and index")
    c.add_argument("-a", "--attribute", default="range")

    c = command("sphericalgrid", "grid returns by azimuth and zenith")
    c.add_argument("-a", "--attribute", default="range")
    c.add_argument("-m", "--method", default="MEAN", choices=sorted(grids.METHODS))
    c.add_argument("-r", "--resolution", type=float, default=1.0, help="degrees")
    c.add_argument("-R", "--range-resolution", type=float, help="metres of a range band")
    c.add_argument("--max-range", type=float, default=120.0)
    c.add_argument("--leaf", action="store_true", help="LEAF shots instead of returns")

    c = command("plantprofile", "vertical plant profiles")
    for name, default in (("height-resolution", 0.5), ("zenith-resolution", 5.0), ("azimuth-resolution", 90.0), ("min-zenith", 35.0), ("max-zenith", 70.0), ("max-height", 50.0), ("min-azimuth", 0.0), ("max-azimuth", 360.0), ("grid-extent", 60.0), ("grid-resolution", 10.0)):
        c.add_argument(f"--{name}", type=float, default=default)
    c.add_argument("-m", "--method", default="WEIGHTED", choices=profiles.METHODS)
    c.add_argument("--invert-azimuth", action="store_true")
    c.add_argument("--sensor-height", type=float)
    c.add_argument("--max-hr", type=float, help="largest horizontal range")
    c.add_argument("--grid-origin", type=float, nargs=2)
    c.add_argument("--ground-plane", action="store_true")
    c.add_argument("--reportfile")
    c.add_argument("--pgap-out")
    c.add_argument("--leaf", action="store_true")

    c = command("voxelization", "voxel model of all scans")
    c.add_argument("-v", "--voxelsize", type=float, default=1.0)
    c.add_argument("-b", "--bounds", type=float, nargs=6, default=(-25, -25, -15, 25, 25, 45))
    c.add_argument("-m", "--min-n", type=int, default=3)
    c.add_argument("-w", "--weights", action="store_true")
    c.add_argument("-g", "--dtm", nargs=4, metavar=("PARQUET", "XMIN", "YMAX", "RES"), help="terrain (row, col, val) and its origin")
    return p


def _pick(df: DataFrame, args) -> DataFrame:
    return df.where(F.col("scan_id").isin(args.scan)) if args.scan else df


def _points(spark: SparkSession, args) -> DataFrame:
    p = pulses.reindex_targets(pulses.distinct_points(_pick(table(spark, args.data, "points_rdb"), args)), args.query)
    return pulses.transformed(p, table(spark, args.data, "scans"))


def _leaf(spark: SparkSession, args, sensor_height: float | None) -> DataFrame:
    raw = _pick(table(spark, args.data, "leaf_shots"), args)
    s = leaf.with_steps(leaf.invalidated(leaf.distinct_shots(raw)), raw)
    return leaf.heights(leaf.angles(s, F.col("nsteps")).withColumn("target_count", leaf.target_count()), sensor_height)


def cartesiangrid(spark: SparkSession, args) -> None:
    p = _points(spark, args)
    value = F.col(args.attribute)
    if args.plane:
        g = ground.ground_plane(p, max(args.extent), max(args.resolution, 5.0), (args.ulc[0] + args.extent[0] / 2, args.ulc[1] - args.extent[1] / 2))
        value = pulses.height_above_plane((g.a, g.b, g.c))
    sinks.write_grid(grids.cartesian(p, args.resolution, value, args.method, tuple(args.extent), tuple(args.ulc)), args.out)


def scangrid(spark: SparkSession, args) -> None:
    p = predicate.where(pulses.distinct_points(_pick(table(spark, args.data, "points_rdb"), args)), args.query)
    sinks.write_grid(grids.scan_grid(p, args.attribute, ["loaded_at", "riegl_id"]), args.out)


def sphericalgrid(spark: SparkSession, args) -> None:
    d = _leaf(spark, args, None) if args.leaf else _points(spark, args)
    value = F.col("range1" if args.leaf and args.attribute == "range" else args.attribute)
    if args.range_resolution:
        g = grids.spherical_ranges(d, args.resolution, args.range_resolution, args.max_range, value, args.method)
    else:
        g = grids.spherical(d, args.resolution, value, args.method)
    sinks.write_grid(g, args.out)


def plantprofile(spark: SparkSession, args) -> None:
    cube = profiles.Cube(args.height_resolution, args.zenith_resolution, args.azimuth_resolution, args.min_zenith, args.max_zenith, 0, args.max_height)
    if args.leaf:
        s = profiles.zenith_window(_leaf(spark, args, args.sensor_height or 0.0), args.min_zenith, args.max_zenith)
        t, s = profiles.leaf_cube(s, cube, args.method)
    else:
        scans = _pick(table(spark, args.data, "scans"), args)
        p = _points(spark, args)
        if args.ground_plane:
            first = scans.orderBy("scan_id").select("tx", "ty").first()
            g = ground.ground_plane(p, args.grid_extent, args.grid_resolution, tuple(args.grid_origin or first))
            height = pulses.height_above_plane((g.a, g.b, g.c))
            if args.reportfile:
                sinks.write_text(g.report(), args.reportfile)
        else:
            p = p.join(scans.select("scan_id", "tz"), "scan_id")
            height = pulses.height_above_sensor_ground(F.col("tz"), args.sensor_height)
        t = profiles.zenith_window(p.withColumn("height", height), args.min_zenith, args.max_zenith, args.max_hr)
        s = pulses.distinct_pulses(_pick(table(spark, args.data, "pulses"), args))
        s = profiles.zenith_window(pulses.transformed_pulses(s, scans), args.min_zenith, args.max_zenith)
        if args.method == "ALL":
            s = pulses.pulse_target_counts(s, p)
        t, s = profiles.targets(t, cube, args.method), profiles.shots(s, cube, args.method)
    cov = profiles.cover(t, s, cube)
    gap = profiles.pgap(cov, cube, args.min_azimuth, args.max_azimuth, args.invert_azimuth)
    sinks.write_profiles(profiles.plant_profiles(gap, cube), args.out)
    if args.pgap_out:
        sinks.write_profiles(profiles.pgap_wide(gap, cube), args.pgap_out)


def voxelization(spark: SparkSession, args) -> None:
    box = voxels.Box(tuple(args.bounds), args.voxelsize)
    p, flag = _points(spark, args), None
    if args.dtm:
        path, xmin, ymax, res = args.dtm[0], *map(float, args.dtm[1:])
        p, flag = voxels.with_ground(p, spark.read.parquet(path), xmin, ymax, res), F.col("ground")
    u = pulses.transformed_pulses(pulses.distinct_pulses(_pick(table(spark, args.data, "pulses"), args)), table(spark, args.data, "scans"))
    sinks.write_voxels(voxels.voxelize(u, p, box, flag), f"{args.out}/voxels")
    v = spark.read.parquet(f"{args.out}/voxels")
    model = voxels.linear_model(v, args.min_n, args.weights)
    model.write.mode("overwrite").parquet(f"{args.out}/model")
    model = spark.read.parquet(f"{args.out}/model")
    voxels.cover_profile(model, box.n[2]).write.mode("overwrite").parquet(f"{args.out}/cover")
    voxels.occlusion(v).write.mode("overwrite").parquet(f"{args.out}/occlusion")
    sinks.write_text(box.config(args.dtm[0] if args.dtm else None), f"{args.out}/config.json")


COMMANDS = {f.__name__: f for f in (cartesiangrid, scangrid, sphericalgrid, plantprofile, voxelization)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if spark is None:
        from gapfold.session import build

        spark = build()
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()

"""Outputs: profiles as CSV, grids and voxels as Parquet, reports as text."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One CSV file with header, five decimals, ordered by Height. A profile is
    at most a few hundred rows, hence the single file."""
    cols = [F.format_string("%.5f", F.col(c).cast("double")).alias(c) for c in profiles.columns]
    profiles.orderBy("Height").select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_grid(grid: DataFrame, path: str) -> None:
    """band, row, col, value[, cnt] as Parquet; absent rows are nodata."""
    names = {"z": "band", "y": "row", "x": "col"}
    grid.select(*[F.col(c).alias(names.get(c, c)) for c in grid.columns]).write.mode("overwrite").parquet(path)


def write_voxels(voxels: DataFrame, path: str) -> None:
    """One folder per scan, sorted by layer, so a reader of one layer skips row
    groups. Salted within a scan, so a large scan is no single task."""
    voxels.repartition("scan_id", F.expr("z div 8")).sortWithinPartitions("scan_id", "z").write.mode("overwrite").partitionBy("scan_id").parquet(path)


def read_voxels(spark: SparkSession, path: str, layers=None, names: list[str] | None = None, scans: list[str] | None = None) -> DataFrame:
    """The stored voxels of some scans, layers and names: scans prune folders,
    layers prune row groups (the files are sorted by layer), names prune columns."""
    v = spark.read.parquet(path)
    if scans is not None:
        v = v.where(F.col("scan_id").isin(list(scans)))
    if layers is not None:
        v = v.where(F.col("z").isin(list(layers)))
    return v.select("scan_id", "x", "y", "z", *(names or [c for c in v.columns if c not in ("scan_id", "x", "y", "z")]))


def write_terrain(dtm: DataFrame, path: str, xmin: float, ymax: float, res: float, nodata: float = NODATA) -> None:
    """A terrain raster (row, col, val) as Parquet sorted by row, its place in
    columns that the encoding stores once."""
    placed = dtm.select("row", "col", "val", *[F.lit(float(v)).alias(k) for k, v in (("xmin", xmin), ("ymax", ymax), ("res", res), ("nodata", nodata))])
    placed.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def read_terrain(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """row, col, val, xmin, ymax, res of a stored terrain, or of a window of it;
    cells without data are left out."""
    t = spark.read.parquet(path)
    for name, ends in (("row", rows), ("col", cols)):
        if ends is not None:
            t = t.where(F.col(name).between(*ends))
    return t.where("val is not null and not isnan(val) and val <> nodata").drop("nodata")


def write_pyramid(grid: DataFrame, path: str, descriptions: list[str] | None = None, factors: tuple[int, ...] = (2, 4, 8)) -> None:
    """A grid with its overviews under factor=1, 2, 4, 8, and the descriptions of
    its bands in a column."""
    from gapfold.operators.grids import overview

    told = F.element_at(F.array(*map(F.lit, descriptions)), F.col("z") + 1) if descriptions else F.lit(None).cast("string")
    for f in (1, *factors):
        g = grid.select("z", "y", "x", "value") if f == 1 else overview(grid, f)
        write_grid(g.withColumn("description", told), f"{path}/factor={f}")


def write_json(spark: SparkSession, text: str, path: str) -> None:
    """A small text where every executor can read it."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\x00")


def read_json(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].rstrip("\x00")


def dense(grid: DataFrame, rows: int, cols: int, bands: int = 1):
    """A NumPy array (band, row, col) with NODATA where nothing is, for export.
    The size is checked: a grid is a result, not a fact table."""
    import numpy as np

    if rows * cols * bands > 50_000_000:
        raise ValueError("the grid is too large for one array")
    out = np.full((bands, rows, cols), NODATA)
    for r in grid.select("z", "y", "x", "value").toLocalIterator():
        if r.value is not None:
            out[r.z, r.y, r.x] = r.value
    return out


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text)

"""Side inputs of a scan: transform files, poses, and vendor formats.

These are a few numbers per scan. Single files are read on the driver; folders of
them are read like any table, into the `scans` dimension.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def read_transform(path: str, single: bool = False) -> dict[str, float]:
    """A 4 x 4 matrix in four lines of four numbers, for column vectors; given
    back for row vectors (transposed), as r00..r22 and tx, ty, tz. single=True
    rounds to single precision as older readers do."""
    m = np.array([[float(x) for x in line.split()] for line in Path(path).read_text().splitlines() if line.strip()])
    if m.shape != (4, 4):
        raise ValueError(f"{path}: not a 4 x 4 matrix")
    m = (m.astype(np.float32).astype(float) if single else m).T
    return {f"r{i}{j}": float(m[i, j]) for i in range(3) for j in range(3)} | dict(zip(("tx", "ty", "tz"), map(float, m[3, :3])))


def read_pose(path: str) -> dict[str, float]:
    """pitch, roll and yaw (degrees) as a rotation without translation; a
    missing or NaN yaw is 0."""
    pose = json.loads(Path(path).read_text())
    p, r, y = (math.radians(pose.get(k) or 0.0) for k in ("pitch", "roll", "yaw"))
    y = 0.0 if math.isnan(y) else y
    pitch = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
    roll = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    yaw = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    m = yaw @ pitch @ roll
    return {f"r{i}{j}": float(m[i, j]) for i in range(3) for j in range(3)} | {"tx": 0.0, "ty": 0.0, "tz": 0.0}


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files in folders scan_id=<name>: scan_id, value."""
    return spark.read.schema("value string, scan_id string").text(path, wholetext=True)


def read_transforms(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """The transform files (four lines of four numbers) in the folders
    scan_id=<name> under `path`, as the scans dimension. A file that does not hold
    16 numbers is an error. single=True rounds to single precision."""
    n = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kind = "float" if single else "double"
    at = lambda i, j: F.get("n", F.lit(4 * i + j)).cast(kind).cast("double")
    cols = [at(j, i).alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [at(i, 3).alias(f"t{a}") for i, a in enumerate("xyz")]
    ok = F.when(F.size("n") != 16, F.raise_error(F.concat(F.lit("not a 4 x 4 matrix: "), "scan_id"))).otherwise(F.col("scan_id"))
    return _texts(spark, path).select("scan_id", n.alias("n")).select(ok.alias("scan_id"), *cols)


def write_transforms(scans: DataFrame, path: str) -> None:
    """The scans' transforms as such files."""
    row = lambda i: F.concat_ws(" ", *[F.col(f"r{j}{i}").cast("string") for j in range(3)], F.col(f"t{'xyz'[i]}").cast("string"))
    scans.select("scan_id", F.concat_ws("\n", *[row(i) for i in range(3)], F.lit("0 0 0 1")).alias("value")).write.mode("overwrite").partitionBy("scan_id").text(path)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, pitch, roll, yaw of the pose files under `path`; a missing or NaN
    yaw is NULL."""
    p = _texts(spark, path).select("scan_id", F.from_json("value", "pitch double, roll double, yaw double").alias("p")).select("scan_id", "p.*")
    return p.withColumn("yaw", F.when(~F.isnan("yaw"), F.col("yaw")))


def write_poses(scans: DataFrame, path: str) -> None:
    scans.select("scan_id", F.to_json(F.struct("pitch", "roll", "yaw")).alias("value")).write.mode("overwrite").partitionBy("scan_id").text(path)


def scans(spark: SparkSession, transforms: dict[str, dict[str, float]]) -> DataFrame:
    """The scans dimension from scan_id to transform."""
    rows = [(k, *[t[c] for c in COLUMNS]) for k, t in transforms.items()]
    return spark.createDataFrame(rows, "scan_id string, " + ", ".join(f"{c} double" for c in COLUMNS))


class VendorFormat(RuntimeError):
    """A scanner's own binary format, which needs the vendor's library."""


def read_vendor(path: str) -> DataFrame:
    """Scanner streams and databases (.rxp, .rdbx) can't be decoded without the
    vendor's library; the interchange is Parquet in the pulses and points
    schemas."""
    raise VendorFormat(f"{path}: needs the scanner vendor's library; convert to Parquet (tables pulses and points_rdb) first")


def manifest(scans: DataFrame, pulses: DataFrame, points: DataFrame) -> DataFrame:
    """scan_id, kind, path, n_pulses, n_points: what there is of each scan."""
    out = scans.select("scan_id", "kind", "path")
    for name, df in (("n_pulses", pulses), ("n_points", points)):
        out = out.join(df.groupBy("scan_id").agg(F.count(F.lit(1)).alias(name)), "scan_id", "left")
    return out.fillna(0, ["n_pulses", "n_points"])

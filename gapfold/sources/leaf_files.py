"""LEAF files: names, headers, scans and power logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfold.operators.badrows import good_rows
from gapfold.operators.leaf_layout import is_blank, is_body, is_comment

# Fixed value: the name of a LEAF scan file.
SCAN_NAME = r"^(\w{8})_(\d{4})_(hemi|hinge|ground)_(\d{8}-\d{6})Z_(\d{4})_(\d{4})(?:\.csv)?$"
POWER_NAME = r"^(\w{8})_pwr_(\d{8})\.csv$"
# Header keys whose value carries a unit.
UNIT_KEYS = ["Batt", "Curr", "Lidar Temp", "Motor Temp", "Encl. Temp", "Encl. humidity"]


def file_name_fields(name: Column) -> dict[str, Column]:
    """The parts of a scan file's name; NULL where the name is no scan's."""
    part = lambda i: F.nullif(F.regexp_extract(name, SCAN_NAME, i), F.lit(""))
    return {
        "serial_number": part(1), "scan_count": part(2).cast("int"), "scan_type": part(3),
        "datetime": F.try_to_timestamp(part(4), F.lit("yyyyMMdd-HHmmss")), "zenith_shots": part(5).cast("int"), "azimuth_shots": part(6).cast("int"),
    }


def parse_file_names(files: DataFrame, column: str = "file_name") -> DataFrame:
    return files.select(column, *[c.alias(k) for k, c in file_name_fields(F.col(column)).items()])


def discovered(files: DataFrame, scan_type: str) -> DataFrame:
    """file_name, file_id (the first received) of the scan files of one type,
    sorted by name."""
    ok = F.col("file_name").rlike(SCAN_NAME) & (F.regexp_extract("file_name", SCAN_NAME, 3) == scan_type)
    return files.where(ok).groupBy("file_name").agg(F.min("file_id").alias("file_id")).orderBy("file_name")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under `path`: file_id (a hash of the path), file_name,
    line_no, line_text.

    Files are read whole, one row each, so line numbers need no shuffle and no
    order between rows; LEAF files are a few hundred kilobytes.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select(F.xxhash64("path").alias("file_id"), name.alias("file_name"), F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n", -1)).alias("pos", "line_text")).select(
        "file_id", "file_name", (F.col("pos") + 1).alias("line_no"), "line_text")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of the scan files under `path`, with the fields of their names.
    Lines that fail to parse are left out (see operators.badrows)."""
    lines = read_lines(spark, path)
    names = lines.select("file_id", "file_name").distinct()
    named = names.select("file_id", *[c.alias(k) for k, c in file_name_fields(F.col("file_name")).items() if k != "scan_count"], F.regexp_replace("file_name", r"\.csv$", "").alias("scan_id"))
    return good_rows(lines).join(named, "file_id")


def meta(lines: DataFrame) -> DataFrame:
    """file_id, section (header or footer), key, value of the `#` lines.

    Before the first body line is the header, after it the footer. `Finished`
    gives the duration, `GPS` its list; values of keys with a unit lose it. The
    last of equal keys of a section stays.
    """
    body = lines.where(is_body(F.col("line_text"))).groupBy("file_id").agg(F.min("line_no").alias("first"))
    text = F.trim("line_text")
    note = lines.where(is_comment(F.col("line_text")) & ~is_blank(F.col("line_text"))).select("file_id", "line_no", text.alias("t"))
    key = F.trim(F.regexp_extract("t", r"^#\s*([^:]*):", 1))
    value = F.trim(F.regexp_extract("t", r"^#[^:]*:(.*)$", 1))
    finished, gps = F.col("t").rlike(r"^#\s*Finished"), F.col("t").rlike(r"^#\s*GPS")
    k = F.when(finished, F.lit("Finished")).when(gps, F.lit("GPS")).otherwise(key)
    v = (F.when(finished, F.regexp_extract("t", r"^#\s*Finished\s+(\S+)", 1)).when(gps, F.trim(F.regexp_extract("t", r"^#\s*GPS:?(.*)$", 1)))
         .when(key.isin(UNIT_KEYS), F.regexp_extract(value, r"^(\S+)", 1)).otherwise(value))
    j = note.join(body, "file_id", "left").select(
        "file_id", F.when(F.col("first").isNull() | (F.col("line_no") < F.col("first")), "header").otherwise("footer").alias("section"), k.alias("key"), v.alias("value"), "line_no")
    return j.where("key <> ''").groupBy("file_id", "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def power_rows(df: DataFrame) -> DataFrame:
    """Power log rows: one per instrument and time, without those that lack humidity."""
    cols = ["battery_voltage", "current", "temperature", "humidity"]
    return df.where("humidity is not null and not isnan(humidity)").groupBy("serial_number", "datetime").agg(
        *[F.max(c).alias(c) for c in cols])


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """The power CSV files under `path`."""
    schema = "datetime string, battery_voltage double, current double, temperature double, humidity double"
    raw = spark.read.schema(schema).csv(path).withColumn("name", F.col("_metadata.file_name"))
    at = F.try_to_timestamp("datetime", F.lit("yyyyMMdd-HHmmss"))
    return power_rows(raw.select(F.regexp_extract("name", POWER_NAME, 1).alias("serial_number"), at.alias("datetime"), "battery_voltage", "current", "temperature", "humidity"))

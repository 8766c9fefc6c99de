"""Far too many small files: consolidation by split packing.

Nothing is shuffled to join small files. The engine's own split packing does it:
`spark.sql.files.maxPartitionBytes` is the size wanted of one split and
`spark.sql.files.openCostInBytes` what opening a file is charged, so one task
reads many tiny files as one combined split; `coalesce` (a narrow dependency)
brings the splits to the wanted number of output files. Output is written to a
staging folder, verified there, moved to its final name, and looked at again.

For a table of tiny files the staged output has two parts: `data`, every record
once, and `log`, the places of the surplus records, which is also the answer to
where they are. Verification reads both back: together they must hold as many
records as the bodies, with the same sum of record hashes, and the times each
record of `data` was sent must add up to both. The bodies are counted by an
expression of its own, so a record lost on the way shows.

The split settings live in a child session of their own, so the caller's
session is left as it was.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfold.session import file_system, fresh_path

_CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")


@dataclass(frozen=True)
class Packing:
    """target_bytes: input bytes of a split. open_cost: bytes one more file in a
    split is charged; small, so that tiny files pack tightly, but not zero, so
    that a task doesn't open without bound (at most target/open_cost files)."""

    target_bytes: int = 128 << 20
    open_cost: int = 64 << 10


def packing_session(spark: SparkSession, packing: Packing) -> SparkSession:
    """A child session that packs splits; shares the cluster, not the settings."""
    s = spark.newSession()
    for k in _CARRIED:
        v = spark.conf.get(k, None)
        if v is not None:
            s.conf.set(k, v)
    s.conf.set("spark.sql.files.maxPartitionBytes", str(packing.target_bytes))
    s.conf.set("spark.sql.files.openCostInBytes", str(packing.open_cost))
    return s


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The settings hold for the actions inside, then the old ones again."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bytes_and_files(spark: SparkSession, path: str) -> tuple[int, int]:
    p, fs = file_system(spark, path)
    c = fs.getContentSummary(p)
    return c.getLength(), c.getFileCount()


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free sum of row hashes: equal multisets agree."""
    cols = sorted(df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def _publish(spark: SparkSession, stage: str, out: str) -> None:
    """Give the staged folder its final name. A file system reports a failed
    rename by its result only, so both that and the outcome are looked at."""
    s, fs = file_system(spark, stage)
    d = file_system(spark, out)[0]
    if fs.exists(d):
        raise FileExistsError(out)
    size = fs.getContentSummary(s).getLength()
    if not fs.rename(s, d) or fs.exists(s) or not fs.exists(d) or fs.getContentSummary(d).getLength() != size:
        raise RuntimeError(f"{stage} could not be renamed to {out}")


def _discard(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def write_verified(df: DataFrame, out: str, files: int, fmt: str = "parquet", options: dict | None = None) -> tuple[int, int]:
    """Write df as at most `files` files under `out`, staged and verified.

    Raises, and leaves no output, if the staged files don't hold exactly df's
    rows or can't be renamed. `out` must not exist.
    """
    spark = df.sparkSession
    stage = out.rstrip("/") + ".staged"
    d, fs = file_system(spark, out)
    if fs.exists(d):
        raise FileExistsError(out)
    want = checksum(df)
    df.coalesce(max(1, files)).write.mode("overwrite").format(fmt).options(**(options or {})).save(stage)
    got = checksum(spark.read.schema(df.schema).format(fmt).options(**(options or {})).load(stage))
    if got != want:
        _discard(spark, stage)
        raise RuntimeError(f"staged output holds {got[0]} rows with sum {got[1]}, the input {want[0]} with {want[1]}")
    _publish(spark, stage, out)
    return want


def compact_directory(spark: SparkSession, src: str, out: str, fmt: str = "parquet", packing: Packing = Packing(), options: dict | None = None) -> dict:
    """Consolidate the files of one folder. Every record stays exactly once;
    an empty folder gives an empty output. Returns a report."""
    opts = options or {}
    size, count = _bytes_and_files(spark, src)
    s = packing_session(spark, packing)
    df = s.read.format(fmt).options(**opts).load(src)
    rows, _ = write_verified(df, out, math.ceil(size / packing.target_bytes), fmt, opts)
    return {"files_in": count, "bytes_in": size, "records": rows, "files_out": _bytes_and_files(spark, out)[1] - 1}


#: Decimal exponents up to which a number is written out in digits.
MOST_ZEROS = 400
#: Lines up to this length whose fields are all plain take the short way.
SHORT_LINE = 400


def _clean(field: Column) -> Column:
    """A field without blanks, one pair of double quotes, and blanks inside it."""
    plain = F.trim(F.translate(field, "\t\r", "  "))
    return F.trim(F.regexp_replace(plain, '^"([^"]*)"$', "$1"))


def _trimmed(integer: Column, fraction: Column) -> Column:
    """Digits before and after the point without zeros that say nothing."""
    i, f = F.regexp_replace(integer, "^0+", ""), F.regexp_replace(fraction, "0+$", "")
    return F.concat(F.when(i == "", "0").otherwise(i), F.when(f == "", "").otherwise(F.concat(F.lit("."), f)))


def exact_number(field: Column) -> Column:
    """A field in decimal notation (sign, digits, point, exponent) as its value
    written out in digits, exactly: equal numbers give equal texts, and others
    never do. An exponent beyond MOST_ZEROS is kept beside its digits. Any other
    text stands for itself, behind an apostrophe."""
    v = _clean(field)
    number = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
    part = lambda i: F.regexp_extract(v, number, i)
    is_number = v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    bare = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) - F.length(part(3)) + F.length(digits) - F.length(bare)
    step = power.cast("int")
    wide = F.abs(power) > MOST_ZEROS
    point = F.length(bare) + step
    told = F.when(wide, F.concat(bare, F.lit("e"), power.cast("string"))).when(step >= 0, F.concat(bare, F.repeat(F.lit("0"), step))).when(
        point > 0, F.concat(F.substring(bare, F.lit(1), point), F.lit("."), F.substring(bare, point + 1, -step))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare))
    sized = F.when(part(4) == "", F.when(F.length(v) <= SHORT_LINE, _trimmed(part(2), part(3))).otherwise(told)).otherwise(told)
    sign = F.when(part(1) == "-", "-").otherwise("")
    return F.when(~is_number, F.concat(F.lit("'"), v)).when(digits == "", "0").otherwise(F.concat(sign, sized))


def fragment_records(fragments: DataFrame) -> DataFrame:
    """One row per record of the tiny files: fragment_id, line_no,
    serial_number, scan_count, record (the line without CR).

    Lines end at LF or CR LF and count from 1, blank and `#` lines included. A
    NULL or empty body has no records.
    """
    lines = fragments.select("fragment_id", "serial_number", "scan_count", F.posexplode(F.split("body", r"\r?\n", -1)).alias("pos", "record"))
    keep = ~F.col("record").startswith("#") & (F.trim(F.translate("record", "\t\r\x0b\x0c", "    ")) != "")
    return lines.where(keep).select("fragment_id", (F.col("pos") + 1).alias("line_no"), "serial_number", "scan_count", "record")


def _plain_line(record: Column) -> Column:
    """The numbers of a line of plain fields, written as exact_number does, by
    passes over the whole line: one for zeros behind a point, and three more only
    where zeros or a point lead."""
    odd = record.rlike(r"(^|,|-)(0[0-9]|\.)|-0")
    short = lambda t: F.regexp_replace(t, r"\.0*(?=,|\z)|(\.[0-9]*[1-9])0+(?=,|\z)", "$1")
    led = F.regexp_replace(short(F.regexp_replace(record, r"(?<=^|,|-)(?=\.)", "0")), r"(?<=^|,|-)0+(?=[0-9])", "")
    return F.when(odd, F.regexp_replace(led, r"-0(?=,|\z)", "0")).otherwise(short(record))


def record_numbers(record: Column) -> Column:
    """The fields of a record as exact numbers, joined by commas."""
    general = F.array_join(F.transform(F.split(record, ",", -1), exact_number), ",")
    # the length comes first: the expression recurses field by field
    plain = (F.length(record) <= SHORT_LINE) & record.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)(,-?([0-9]+\.?[0-9]*|\.[0-9]+))*\z")
    return F.when(plain, _plain_line(record)).otherwise(general)


def record_key(record: Column) -> Column:
    """16 bytes (MD5) that agree for two records whose fields are equal as
    numbers."""
    return F.unhex(F.md5(record_numbers(record)))


def _place(fragment_id: str = "fragment_id", line_no: str = "line_no") -> Column:
    """(fragment_id, line_no) as one number in the same order, so that the least
    place is a plain hash aggregate. A NULL fragment_id comes before all."""
    high = F.coalesce(F.col(fragment_id).cast("decimal(20,0)"), F.lit(str(-(1 << 64))).cast("decimal(20,0)"))
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + F.col(line_no)).cast("decimal(38,0)")


def first_places(records: DataFrame) -> DataFrame:
    """place and times of every record: where it stands first and how often it
    was sent. Combined before the shuffle, so a record sent again and again (even
    a third of all rows) is one row per task."""
    keyed = records.select("serial_number", "scan_count", record_key(F.col("record")).alias("key"), _place().alias("place"))
    return keyed.groupBy("serial_number", "scan_count", "key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times")).select("place", "times")


def sorted_out(fragments: DataFrame) -> DataFrame:
    """Every record with `times`: how often it was sent, at its first place; NULL
    where it is surplus. The first places meet the records by place, a key that
    no two records share, so nothing is hot."""
    rec = fragment_records(fragments)
    one = rec.withColumn("place", _place()).alias("r")
    return one.join(first_places(rec).alias("p"), "place", "left").select("fragment_id", "line_no", "serial_number", "scan_count", "record", "times")


def body_records(fragments: DataFrame) -> dict:
    """What the bodies hold, counted apart from fragment_records: fragments, bytes,
    records, and the sum of the records' hashes."""
    t = fragments.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("bytes")).first()
    lines = fragments.select("serial_number", "scan_count", F.explode(F.split("body", "\n", -1)).alias("line")).where(F.col("line").rlike("^[^#]") & F.col("line").rlike(r"[^ \t\r\x0B\f]"))
    r = lines.agg(F.count(F.lit(1)).alias("records"), F.sum(_hash(F.col("serial_number"), F.col("scan_count"), F.rtrim(F.col("line"), F.lit("\r")))).alias("h")).first()
    return {"fragments": t["n"], "bytes": t["bytes"] or 0, "records": r["records"], "hash": int(r["h"] or 0)}


def distinct_fragments(fragments: DataFrame) -> DataFrame:
    """fragments with repeated rows once. Bodies move only where an id is
    repeated, which a count of the ids tells. Different bodies under one id have
    no places of their own; their consolidation is refused."""
    own = fragments.select("fragment_id", "serial_number", "scan_count", "body")
    again = own.groupBy("fragment_id").count().where("count > 1").limit(1).count()
    return own.dropDuplicates() if again else own


def _hash(*cols: Column) -> Column:
    return F.xxhash64(*cols).cast("decimal(38,0)")


def _verify(spark: SparkSession, stage: str, schema, bodies: dict) -> int:
    """Records in the staged data; raises unless data and log together hold the
    bodies, each record once in data."""
    got = {}
    for part in ("data", "log"):
        df = spark.read.schema(schema).parquet(f"{stage}/{part}")
        got[part] = df.agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"), F.sum(_hash(F.col("serial_number"), F.col("scan_count"), F.rtrim(F.col("record"), F.lit("\r")))).alias("h")).first()
    data, log = got["data"], got["log"]
    held = (data["n"] + log["n"], int(data["h"] or 0) + int(log["h"] or 0), data["times"] or 0)
    if held != (bodies["records"], bodies["hash"], bodies["records"]):
        raise RuntimeError(f"staged output holds {held}, the bodies {bodies}")
    return data["n"]


def compact_fragments(fragments: DataFrame, out: str, packing: Packing = Packing()) -> dict:
    """Consolidate the records of a table of tiny files into well-sized Parquet
    files under `out`/data, each record once, and the surplus ones under
    `out`/log; returns a report. Raises, and leaves no output, if a record of the
    bodies is in neither, or the data holds one twice.

    The number of output files follows from the bytes of the bodies.
    """
    spark = fragments.sparkSession
    stage = out.rstrip("/") + ".staged"
    d, fs = file_system(spark, out)
    if fs.exists(d):
        raise FileExistsError(out)
    fragments = distinct_fragments(fragments)
    bodies = body_records(fragments)
    files = max(1, math.ceil(bodies["bytes"] / packing.target_bytes))
    # the shuffles must have at least as many parts as there are files to write
    parts = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = sorted_out(fragments)
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(packing.target_bytes)}):
        one = rows.withColumn("part", F.when(F.col("times").isNull(), "log").otherwise("data")).coalesce(files)
        one.write.mode("overwrite").partitionBy("part").parquet(stage)
    try:
        for part in ("data", "log"):
            old, new = f"{stage}/part={part}", f"{stage}/{part}"
            if fs.exists(file_system(spark, old)[0]):
                _publish(spark, old, new)
            else:
                fs.mkdirs(file_system(spark, new)[0])
        records = _verify(spark, stage, rows.schema, bodies)
        _publish(spark, stage, out)
    except Exception:
        _discard(spark, stage)
        raise
    return {"files_in": bodies["fragments"], "bytes_in": bodies["bytes"], "records": records, "files_out": _bytes_and_files(spark, f"{out}/data")[1]}


def surplus_records(fragments: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """The records that occur at a smaller (fragment_id, line_no) already: the
    log of a verified consolidation into the shared folder."""
    out = fresh_path(fragments.sparkSession, "compacted")
    compact_fragments(fragments, out, packing)
    schema = fragments.select("fragment_id", F.lit(0).alias("line_no")).schema
    return fragments.sparkSession.read.schema(schema).parquet(f"{out}/log")


def compaction_report(fragments: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """compact_fragments into the shared folder, its report as one row, with the
    surplus records left out and whether the files are as many as their bytes ask
    for."""
    spark = fragments.sparkSession
    r = compact_fragments(fragments, fresh_path(spark, "compacted"), packing)
    well = r["files_out"] <= max(1, math.ceil(r["bytes_in"] / packing.target_bytes))
    return spark.createDataFrame([(r["files_in"], r["bytes_in"], r["records"], well)], "files_in long, bytes_in long, records long, well_sized boolean")

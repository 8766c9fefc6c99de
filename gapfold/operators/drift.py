"""Schemas that drift between files.

Every file's header gives its columns; its good rows say which types can hold
each of them. A type is a set of the storage types that hold a value exactly
(long, double, decimal(38,0), text), and types fold by intersection: the lattice
of promotion. The fold over all files is the union schema, to which every file
is cast, so no value present is lost. The differences between neighbouring files
of an instrument, in order of time, are the log, each with the file in which it
first shows and the union type its field is cast to.

The log speaks of three kinds of a field in a file: integer < decimal < text
(text as soon as a value is no plain signed decimal number).

Defined results: a file received twice (same file_name) counts once, as its
smallest file_id; files of equal datetime are ordered by file_name; a file
without lines has no layout and is passed over; a field without any value in a
file is integer (nothing in it is text or has a point) and fits every type; an
instrument with one file has no change; empty tables give no rows; a column no
rule knows is a field of its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfold.operators.badrows import layouts_of, parse_lines
from gapfold.operators.leaf_layout import COLUMNS_NEW
from gapfold.operators.sharded import with_previous
from gapfold.session import written

#: The kinds of the log, lowest first.
LATTICE = ["integer", "decimal", "text"]
#: Storage types, the first that holds all values is the union type; each is a bit of a value's set.
STORAGE = [("bigint", 1), ("double", 2), ("decimal(38,0)", 4), ("string", 8)]
#: Files of one instrument are compared inside shards of so many days.
SHARD_DAYS = 30
#: Names of columns that may be found in all headers; more are no schema.
MAX_NAMES = 10_000


# The common notations, told first: they are never missing.
_SHORT_INTEGER, _SHORT_DECIMAL = r"^[0-9]{1,15}\z", r"^[0-9]{1,9}\.[0-9]{1,6}\z"


def _value(field: str) -> Column:
    return F.trim(F.get("values", (F.array_position("fields", field) - 1).cast("int")))


def is_missing(value: Column) -> Column:
    """NULL, empty, or -1.0 in any notation."""
    return F.coalesce((value == "") | value.startswith("-") & value.rlike(r"^-0*1(\.0*)?\z"), F.lit(True))


def level(value: Column) -> Column:
    """Place on the log's lattice of one text value; NULL for a missing one."""
    plain = value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z")
    return F.when(value.rlike(_SHORT_INTEGER), 0).when(value.rlike(_SHORT_DECIMAL), 1).when(is_missing(value), None).when(~plain, 2).when(value.contains("."), 1).otherwise(0)


def holders(value: Column) -> Column:
    """Bits of the storage types that hold one text value exactly; NULL for a
    missing one. A double holds 15 significant digits."""
    whole = F.length(F.regexp_replace(value, r"^[+-]?0*", ""))
    digits = F.length(F.regexp_replace(F.regexp_replace(value, r"[eE].*$|[.+-]", ""), r"^0+|0+$", ""))
    size = F.abs(value.try_cast("double"))
    safe = (digits <= 15) & ((size == 0) & (digits == 0) | size.between(1e-290, 1e290))
    return (F.when(value.rlike(_SHORT_INTEGER), 15).when(value.rlike(_SHORT_DECIMAL), 10).when(is_missing(value), None)
            .when(value.rlike(r"^[+-]?[0-9]+\z"), F.when(whole <= 15, 15).when(whole <= 18, 13).when(whole <= 38, 12).otherwise(8))
            .when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z") & F.coalesce(safe, F.lit(False)), 10).otherwise(8))


def file_schemas(lines: DataFrame, fields: list[str], layouts: DataFrame | None = None) -> DataFrame:
    """file_id, and for each field, as s0, s1, ..., a struct (name as written,
    level, holders)."""
    own = lines.select("file_id", "line_no", "line_text")
    layouts = layouts_of(own) if layouts is None else layouts
    good = parse_lines(own, layouts).where("reason is null").select("file_id", *[_value(f).alias(f"v{i}") for i, f in enumerate(fields)])
    types = good.groupBy("file_id").agg(*[g(f"v{i}").alias(f"{n}{i}") for i in range(len(fields)) for n, g in (
        ("l", lambda c: F.max(level(F.col(c)))), ("h", lambda c: F.bit_and(holders(F.col(c)))))])
    at = lambda f: F.get("names", (F.nullif(F.array_position("fields", f), F.lit(0)) - 1).cast("int"))
    a, b = layouts.alias("a"), types.alias("b")
    return a.join(b, F.col("a.file_id").eqNullSafe(F.col("b.file_id")), "left").select(
        "a.file_id", *[F.struct(at(f).alias("name"), F.coalesce(f"l{i}", F.lit(0)).alias("level"), F.coalesce(f"h{i}", F.lit(15)).alias("holders")).alias(f"s{i}") for i, f in enumerate(fields)])


def fold(schemas: DataFrame, fields: list[str]) -> dict[str, str]:
    """The union schema: the type of each field over all files. One row comes to
    the driver."""
    r = schemas.agg(*[F.bit_and(f"s{i}.holders").alias(f"h{i}") for i in range(len(fields))]).first()
    return {f: next(t for t, bit in STORAGE if (15 if r[i] is None else r[i]) & bit) for i, f in enumerate(fields)}


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per file_name: the copy with the smallest file_id."""
    pick = files.groupBy("file_name").agg(F.min_by(F.struct("file_id", "serial_number", "scan_count", "datetime"), "file_id").alias("f"))
    return pick.select("file_name", "f.*")


def change_log(lines: DataFrame, files: DataFrame, fields: tuple[str, ...] = ("intensity2", "scan_encoder")) -> DataFrame:
    """The log of the fold: serial_number, at (the later file's datetime),
    scan_count (of the later file), field_name, change_kind, before, after,
    file_name, union_type."""
    wanted = list(fields)
    schemas = written(file_schemas(lines, wanted), "schemas")
    union = fold(schemas, wanted)
    own = files.select("file_id", "file_name", "serial_number", "scan_count", "datetime")
    long = distinct_files(own).join(schemas, "file_id").select(
        "serial_number", "scan_count", "datetime", "file_name",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(union[f]).alias("union_type"), F.col(f"s{i}.name").alias("name"), F.col(f"s{i}.level").alias("level")) for i, f in enumerate(wanted)])).alias("x"),
    ).select("serial_number", "scan_count", "datetime", "file_name", "x.*").withColumn("here", F.lit(True))
    shard = F.floor(F.unix_date(F.to_date("datetime")) / SHARD_DAYS)
    seq = with_previous(long, ["serial_number", "field_name"], shard, ["datetime", "file_name"], ["name", "level", "here"])
    p = F.col("prev")
    kind = F.array_compact(F.array(
        F.when(p["name"].isNull() & F.col("name").isNotNull(), F.lit("added")),
        F.when(p["name"].isNotNull() & F.col("name").isNull(), F.lit("removed")),
        F.when(p["name"] != F.col("name"), F.lit("renamed")),
        F.when(p["name"].isNotNull() & F.col("name").isNotNull() & (p["level"] != F.col("level")), F.lit("retyped"))))
    word = lambda x: F.element_at(F.array(*map(F.lit, LATTICE)), x + 1)
    tell = lambda k, name, lev: F.when(k == "retyped", word(lev)).otherwise(name)
    out = seq.where(p["here"].isNotNull()).withColumn("change_kind", F.explode(kind))
    return out.select(
        "serial_number", F.col("datetime").alias("at"), "scan_count", "field_name", "change_kind",
        tell(F.col("change_kind"), p["name"], p["level"]).alias("before"), tell(F.col("change_kind"), F.col("name"), F.col("level")).alias("after"), "file_name", "union_type")


def union_fields(layouts: DataFrame) -> list[str]:
    """The LEAF fields, then every other field of any header by name."""
    names = layouts.select(F.explode("fields").alias("f")).where(~F.col("f").isin(COLUMNS_NEW)).distinct().limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} column names in the headers")
    return [*COLUMNS_NEW, *sorted(r["f"] for r in names)]


def unified_rows(lines: DataFrame) -> DataFrame:
    """All good rows of all files as one table in the union schema: file_id,
    line_no, the LEAF fields, and every other column found in a header under its
    own name (with `_` behind it where it would clash). Missing values (-1.0,
    empty, or a field the file lacks) are NULL; every other value is kept, a text
    without its outer blanks."""
    own = lines.select("file_id", "line_no", "line_text")
    layouts = layouts_of(own)
    fields = union_fields(layouts)
    union = fold(file_schemas(own, fields, layouts), fields)
    cols = []
    for f in fields:
        v = _value(f)
        cols.append(F.when(~is_missing(v), v if union[f] == "string" else F.regexp_replace(v, r"^\+", "").cast(union[f])).alias(f + "_" if f in ("file_id", "line_no") else f))
    return parse_lines(own, layouts).where("reason is null").select("file_id", "line_no", *cols)

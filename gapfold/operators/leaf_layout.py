"""Column layouts of LEAF files, found from their header lines.

A layout is needed before a body line can be judged: the file's header may name
its columns under any label and with any separator; without such a line the
firmware number decides (intensity2 exists from 4.11 on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a LEAF scan file, newer and older firmware.
COLUMNS_NEW = ["sample_count", "scan_encoder", "rotary_encoder", "range1", "intensity1", "range2", "intensity2", "sample_time"]
COLUMNS_OLD = ["sample_count", "scan_encoder", "rotary_encoder", "range1", "intensity1", "range2", "sample_time"]
FIRMWARE_NEW = 4.11


def is_comment(text: Column) -> Column:
    return F.coalesce(text.startswith("#"), F.lit(False))


def is_blank(text: Column) -> Column:
    """NULL counts as blank."""
    return F.coalesce(~text.rlike(r"[^ \t\r\n\x0B\f]"), F.lit(True))


def is_body(text: Column) -> Column:
    return ~is_comment(text) & ~is_blank(text)


def _bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def header_names(text: Column) -> Column:
    """The column names on a `#` line, or NULL if the line names none.

    The label ends at the first colon before any separator. Names are split at
    commas, semicolons, bars or tabs, else at blanks. A line counts as naming
    columns if three or more of the LEAF names stand on it.
    """
    rest = F.regexp_replace(F.regexp_replace(text, r"[\r\n]+$", ""), r"^#[ \t]*([^,;|\t:=]*[:=])?", "")
    marked = F.split(rest, r"[,;|\t]")
    names = F.when(F.size(marked) > 1, marked).otherwise(F.split(F.trim(rest), r"\s+"))
    names = F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(x, '"', ""))), lambda x: x != "")
    known = F.array(*[F.lit(c.replace("_", "")) for c in COLUMNS_NEW])
    return F.when(F.size(F.array_intersect(F.transform(names, _bare), known)) >= 3, names)


def _tokens(name: Column) -> Column:
    """The words and numbers of a name, in lower case between blanks:
    `scanEncoderCount2` gives ` scan encoder count 2 `."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Za-z])(?=[0-9])|([0-9])(?=[A-Za-z])", "$1$2 ")
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(apart, "[^A-Za-z0-9]+", " ")), F.lit(" "))


def canonical(names: Column) -> Column:
    """Field of each column: the LEAF field its name spells or says in other
    words (an encoder that is not the rotary one; an intensity or amplitude of the
    second return), else its own name: what a column holds is not guessed from
    its place or its values, so an unknown one stays unresolved and is carried
    under its own name."""

    def one(name: Column) -> Column:
        bare, said = _bare(name), _tokens(name)
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for c in COLUMNS_NEW:
            out = out.when(bare == c.replace("_", ""), c)
        out = out.when(said.rlike(" (enc|encoder) ") & ~said.rlike(" (rot|rotary|azi|azimuth) "), "scan_encoder")
        out = out.when(said.rlike(" (int|intensity|amp|amplitude|refl|reflectance) ") & said.rlike(" (2|2nd|second) "), "intensity2")
        return out.otherwise(F.lower(F.trim(name)))

    return F.transform(names, one)


def file_layouts(lines: DataFrame) -> DataFrame:
    """One row per file_id with body lines or header lines:
    file_id, names (as written), fields (canonical).

    Header lines are the `#` lines before the first body line. Both aggregates
    combine before the shuffle, so a file that holds a third of all lines costs
    one row per task. A file with neither names nor a firmware number gets the
    older columns. A NULL file_id is a file of its own.
    """
    body = lines.where(is_body(F.col("line_text"))).groupBy("file_id").agg(F.min("line_no").alias("first_body"))
    text = F.col("line_text")
    head = (
        lines.where(text.startswith("#"))
        .select("file_id", "line_no", header_names(text).alias("names"),
                F.regexp_extract(text, r"(?i)^#\s*Firmware\s*ver\.?\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1).alias("fw"))
        .where("names is not null or fw <> ''")
        .groupBy("file_id")
        .agg(
            F.min_by(F.when(F.col("names").isNotNull(), F.struct("line_no", "names")), F.when(F.col("names").isNotNull(), F.col("line_no"))).alias("named"),
            F.min_by(F.when(F.col("fw") != "", F.struct("line_no", "fw")), F.when(F.col("fw") != "", F.col("line_no"))).alias("ver"),
        )
    )
    b, h = body.alias("b"), head.alias("h")
    both = b.join(h, F.col("b.file_id").eqNullSafe(F.col("h.file_id")), "full").select(
        F.coalesce("b.file_id", "h.file_id").alias("file_id"), "first_body", "named", "ver")
    before = lambda s: F.col("first_body").isNull() | (F.col(f"{s}.line_no") < F.col("first_body"))
    fw = F.when(before("ver"), F.expr("try_cast(ver.fw as double)"))
    default = F.when(fw >= FIRMWARE_NEW, F.array(*map(F.lit, COLUMNS_NEW))).otherwise(F.array(*map(F.lit, COLUMNS_OLD)))
    names = F.coalesce(F.when(before("named"), F.col("named.names")), default)
    return both.select("file_id", names.alias("names")).withColumn("fields", canonical(F.col("names")))

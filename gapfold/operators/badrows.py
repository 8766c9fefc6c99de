"""Rows that fail to parse: minimum-cost error parse of LEAF body lines.

Every body line is parsed under the layout of its file. The parse is a dynamic
programme over the characters that may delete or insert quotes and delimiters
at a cost; a line that needs no edit and whose sample_count and sample_time are
sound loads as a row, any other line is set apart, and its cheapest edits say
why. A quote edit outweighs any number of delimiter edits, and those outweigh
value edits, so the reason is the heaviest kind of edit in the cheapest parse:
`quoting`, `columns`, `value`.

Where the delimiters that a line lacks go is decided by the types: inside a plain
field that is no number but is made of several (`100-1.0`, `5.5.7`, `12 80`),
between those; else at the end of the line, as of a line cut short. A number is
never cut in two, which would make any line valid, and no delimiter is put beside
a quote, which would turn a misplaced quote into a missing delimiter.

A line without any quote and without a fault is its own zero-cost parse: its only
alignment is the split at commas, which the JVM does. Only the other lines go
through the Python kernel, which runs the programme for a whole Arrow batch at
once with NumPy; the lines set apart are found there alone.

Defined results: NULL text counts as blank and is not judged; empty files give
no rows; rows written twice are judged twice; a NULL file_id is a file of its
own (older columns); columns beyond file_id, line_no and line_text are ignored,
whatever they are called. Lines of any length: the time is linear in it, and the
trace is kept in blocks, so memory is that of the line and one block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfold.operators.leaf_layout import file_layouts, is_body
from gapfold.operators.sharded import checked_side
from gapfold.session import Scratch, written

QUOTE_COST, DELIM_COST = 1 << 40, 1 << 16
_INF = 1 << 60
#: Cells of the back-pointer table held at once; the trace of longer or more lines is cut into blocks.
TRACE_CELLS = 32_000_000
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
#: Back pointer: the state before, and what was done.
_OPENED, _DELETED, _PASSED, _INSERTED = 4, 8, 16, 32
_COUNT = re.compile(r"[ \t]*\+?([0-9]+)[ \t]*", re.A)
_TIME = re.compile(r"[ \t]*\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t]*", re.A)
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_EACH = re.compile(_NUMBER, re.A)


def _classes(texts: list[str], width: int) -> np.ndarray:
    """Character classes: 0 other, 1 blank, 2 comma, 3 quote, 4 past the end."""
    out = np.full((len(texts), width), 4, np.uint8)
    table = np.zeros(256, np.uint8)
    table[[32, 9]] = 1
    table[44] = 2
    table[34] = 3
    for i, t in enumerate(texts):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(code)] = table[np.where(code < 256, code, 0)]
    return out


def _seams(text: str) -> list[int]:
    """Places in plain fields where one number ends and the next begins."""
    out, start = [], 0
    for field in text.split(","):
        parts = list(_EACH.finditer(field))
        if len(parts) > 1 and not _EACH.sub("", field).strip(" \t") and not _TIME.fullmatch(field):
            out += [start + m.start() for m in parts[1:]]
        start += len(field) + 1
    return out


def _step(cost: np.ndarray, c: np.ndarray, seam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One character of every line: the new costs and the back pointers."""
    s, u, q, e = (cost[:, k] for k in range(4))
    open_in = s + QUOTE_COST < q
    q1 = np.where(open_in, s + QUOTE_COST, q)
    q1b = np.where(open_in, _START | _OPENED, _QUOTED).astype(np.uint8)
    close_in = q + QUOTE_COST < e
    e1 = np.where(close_in, q + QUOTE_COST, e)
    e1b = np.where(close_in, _QUOTED | _OPENED, _CLOSED).astype(np.uint8)
    new, nb = cost.copy(), np.broadcast_to(np.arange(4, dtype=np.uint8)[None, :, None], cost.shape).copy()
    m = c == 0
    if m.any():
        best, frm = np.minimum(s[m], u[m]), np.where(s[m] < u[m], _START, _PLAIN).astype(np.uint8)
        if seam.any():
            cut = np.full_like(best, _INF)
            cut[:, 1:] = np.where(seam[m][:, None], u[m][:, :-1] + DELIM_COST, _INF)
            frm[cut < best] = _PLAIN | _INSERTED
            best = np.minimum(best, cut)
        new[m, _START] = _INF
        new[m, _PLAIN], nb[m, _PLAIN] = best, frm
        new[m, _QUOTED], nb[m, _QUOTED] = q1[m], q1b[m]
        new[m, _CLOSED] = _INF
    m = c == 1
    if m.any():
        new[m, _QUOTED], nb[m, _QUOTED] = q1[m], q1b[m]
        new[m, _CLOSED], nb[m, _CLOSED] = e1[m], e1b[m]
    m = c == 2
    if m.any():
        three = np.stack([s[m], u[m], e1[m]])
        best, which = three.min(0), three.argmin(0)
        frm = np.where(which == 2, e1b[m], which.astype(np.uint8)) | _PASSED
        passed, pb = np.full_like(best, _INF), np.zeros_like(frm)
        passed[:, 1:], pb[:, 1:] = best[:, :-1], frm[:, :-1]
        stay = s[m] + DELIM_COST
        keep = passed <= stay
        new[m, _START], nb[m, _START] = np.where(keep, passed, stay), np.where(keep, pb, _START | _DELETED)
        new[m, _PLAIN], nb[m, _PLAIN] = u[m] + DELIM_COST, _PLAIN | _DELETED
        new[m, _CLOSED], nb[m, _CLOSED] = e1[m] + DELIM_COST, e1b[m] | _DELETED
        new[m, _QUOTED], nb[m, _QUOTED] = q1[m], q1b[m]
    m = c == 3
    if m.any():
        new[m, _START], nb[m, _START] = s[m] + QUOTE_COST, _START | _DELETED
        new[m, _PLAIN], nb[m, _PLAIN] = u[m] + QUOTE_COST, _PLAIN | _DELETED
        opened, kept = s[m], q[m] + QUOTE_COST
        new[m, _QUOTED], nb[m, _QUOTED] = np.minimum(opened, kept), np.where(opened <= kept, _START, _QUOTED | _DELETED)
        closed, kept = q1[m], e[m] + QUOTE_COST
        new[m, _CLOSED], nb[m, _CLOSED] = np.minimum(closed, kept), np.where(closed <= kept, q1b[m], _CLOSED | _DELETED)
    return np.minimum(new, _INF, out=new), nb


def _runs(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The lines as runs of characters that the programme treats alike: a comma
    or a quote each, a stretch of blanks or of other characters up to the next
    seam. Per line and run the class (4 past the end) and whether a seam stands
    before it; per line where its runs begin, and its length."""
    size, width = len(texts), max((len(t) for t in texts), default=0)
    cls = _classes(texts, width)
    seam = np.zeros((size, width), bool)
    for i, t in enumerate(texts):
        if t.count(",") < n - 1:
            seam[i, _seams(t)] = True
    head = (cls == 2) | (cls == 3) | seam
    head[:, :1] = True
    head[:, 1:] |= cls[:, 1:] != cls[:, :-1]
    head &= cls != 4
    count = head.sum(1)
    line, at = np.nonzero(head)
    place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    most = int(count.max(initial=0))
    kind, cut = np.full((size, most), 4, np.uint8), np.zeros((size, most), bool)
    kind[line, place], cut[line, place] = cls[line, at], seam[line, at]
    begins = [own.tolist() + [len(t)] for own, t in zip(np.split(at, np.cumsum(count)[:-1]), texts)]
    return kind, cut, begins


def align(texts: list[str], n: int, cells: int = TRACE_CELLS) -> list[tuple[int, int, list[str], list[str]]]:
    """For each line: quote edits, delimiter edits, the edits in words, and the
    n fields of the cheapest parse (without quotes and outer blanks).

    State: where in a field the run of characters stands (start, plain, quoted,
    after the closing quote) and how many delimiters were passed. Of parses of
    equal cost the one with delimiters inserted at seams is taken before the one
    with delimiters at the end. Costs are kept at the head of each block of runs;
    the back pointers of the last block are at hand, those of a block before it
    are worked out again on the way back."""
    size = len(texts)
    cls, seam, begins = _runs(texts, n)
    width = cls.shape[1]
    cost = np.full((size, 4, n), _INF, np.int64)
    cost[:, _START, 0] = 0
    block = max(64, cells // (size * 4 * n))
    heads, back = [], []
    for t in range(width):
        if t % block == 0:
            heads.append(cost)
            back = []
        cost, nb = _step(cost, cls[:, t], seam[:, t])
        back.append(nb)
    final = cost + ((n - 1 - np.arange(n)) * (DELIM_COST + 1))[None, None, :]
    final[:, _QUOTED] += QUOTE_COST
    flat = final.reshape(size, -1)
    at = flat.argmin(1)
    total = flat[np.arange(size), at]
    state, j = (at // n).tolist(), (at % n).tolist()
    edits = [["insert quote at end"] * (state[i] == _QUOTED) + [f"insert {n - 1 - j[i]} delimiter(s) at end"] * (j[i] < n - 1) for i in range(size)]
    fields: list = [[[] for _ in range(n)] for _ in range(size)]
    for number in range(len(heads) - 1, -1, -1):
        first, stop = number * block, min(width, (number + 1) * block)
        now = heads.pop()
        if stop < width:
            back = []
            for t in range(first, stop):
                now, nb = _step(now, cls[:, t], seam[:, t])
                back.append(nb)
        way = np.stack(back).reshape(stop - first, size, 4 * n)
        for i, text in enumerate(texts):
            st, k, own, told, begin = state[i], j[i], fields[i], edits[i], begins[i]
            steps = way[:, i].tolist()
            for t in range(min(stop, len(begin) - 1) - 1, first - 1, -1):
                b, x = steps[t - first][st * n + k], begin[t]
                c = text[x]
                if b & _DELETED:
                    told.append(f"delete {'quote' if c == chr(34) else 'delimiter'} at {x + 1}")
                elif b & _PASSED:
                    k -= 1
                elif c != '"' and not (c in " \t" and st in (_START, _CLOSED)):
                    own[k].append(text[x : begin[t + 1]])
                if b & _INSERTED:
                    told.append(f"insert delimiter before {x + 1}")
                    k -= 1
                if b & _OPENED:
                    told.append(f"insert quote before {x + 1}")
                st = b & 3
            state[i], j[i] = st, k
    return [(int(v // QUOTE_COST), int(v % QUOTE_COST // DELIM_COST), told[::-1], ["".join(reversed(f)).strip(" \t") for f in own]) for v, told, own in zip(total, edits, fields)]


def value_edits(fields: list[str], count_at: int, time_at: int) -> list[str]:
    """What keeps sample_count and sample_time from loading."""
    bad = []
    if count_at >= 0:
        m = _COUNT.fullmatch(fields[count_at])
        digits = m and m[1].lstrip("0")
        if not m or len(digits) > 10 or int(digits or 0) > 2147483647:
            bad.append("replace sample_count")
    if time_at >= 0 and not (_TIME.fullmatch(fields[time_at]) and float(fields[time_at]) < float("inf")):
        bad.append("replace sample_time")
    return bad


_RESULT = [
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("quote_edits", T.IntegerType()),
    T.StructField("delimiter_edits", T.IntegerType()),
    T.StructField("edits", T.StringType()),
]


def _parse_batch(text: list[str], n: list[int], count_at: list[int], time_at: list[int]) -> list[tuple]:
    """values, reason, quote edits, delimiter edits and edits of each line; lines
    of like width and length go through the programme together."""
    res: list = [None] * len(text)
    todo = sorted(range(len(text)), key=lambda i: (n[i], len(text[i])))
    k = 0
    while k < len(todo):
        cols, stop = n[todo[k]], k + 1
        while stop < len(todo) and n[todo[stop]] == cols and (stop + 1 - k) * max(1, len(text[todo[stop]])) * 4 * cols <= TRACE_CELLS:
            stop += 1
        batch = todo[k:stop]
        for i, (quotes, delims, edits, fields) in zip(batch, align([text[i] for i in batch], cols)):
            bad = [] if quotes or delims else value_edits(fields, count_at[i], time_at[i])
            reason = "quoting" if quotes else "columns" if delims else "value" if bad else None
            res[i] = (fields, reason, quotes, delims, "; ".join(edits + bad))
        k = stop
    return res


def _kernel(batches):
    for b in batches:
        col = lambda name: b.column(b.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
        got = _parse_batch(col("text"), col("n"), col("count_at"), col("time_at"))
        kept = ["file_id", "line_no", "names", "fields"]
        types = [pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(c)) for c in kept], *[pa.array([g[i] for g in got], t) for i, t in enumerate(types)]], [*kept, *[f.name for f in _RESULT]])


def _without_cr(text: Column) -> Column:
    return F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _sound(fields: Column, count_at: Column, time_at: Column) -> Column:
    """Are sample_count and sample_time (where the layout has them) sound? The
    plain notations are told by one expression each; only others are worked out."""
    count, time = F.get(fields, count_at), F.get(fields, time_at)
    digits = F.regexp_replace(F.trim(F.translate(count, "\t", " ")), r"^\+?0*", "")
    whole = F.when(digits == "", F.lit(0)).otherwise(F.when(F.length(digits) <= 10, digits).try_cast("long"))
    good_count = count.rlike(r"^[ \t]*[0-9]{1,9}[ \t]*\z") | count.rlike(r"^[ \t]*\+?[0-9]+[ \t]*\z") & F.coalesce(whole <= 2147483647, F.lit(False))
    number = F.trim(F.translate(time, "\t", " "))
    good_time = time.rlike(r"^[ \t]*[0-9]{1,15}(\.[0-9]{0,15})?[ \t]*\z") | time.rlike(r"^[ \t]*\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z") & (
        number.try_cast("double") < F.lit(float("inf")))
    return F.coalesce(((count_at < 0) | good_count) & ((time_at < 0) | good_time), F.lit(False))


def layouts_of(lines: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """file_layouts, written: they serve several branches."""
    return written(file_layouts(lines.select("file_id", "line_no", "line_text")), "layouts", scratch)


def _rows(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Body lines with their file's layout, and whether they are clean. The
    layouts (one narrow row per file) are broadcast up to a checked size, beyond
    it they meet the lines in a join that the engine splits where a file is hot."""
    side = checked_side(layouts.select(
        "file_id", "names", "fields", F.size("names").alias("n"),
        F.coalesce(F.array_position("fields", "sample_count") - 1, F.lit(-1)).cast("int").alias("count_at"),
        F.coalesce(F.array_position("fields", "sample_time") - 1, F.lit(-1)).cast("int").alias("time_at")),
        F.octet_length(F.array_join("names", ",")) + F.octet_length(F.array_join("fields", ",")) + 64 * F.size("names"))
    own = lines.select("file_id", "line_no", "line_text")
    a, b = own.where(is_body(F.col("line_text"))).withColumn("text", _without_cr(F.col("line_text"))).alias("a"), side.alias("b")
    rows = a.join(b, F.col("a.file_id").eqNullSafe(F.col("b.file_id")), "inner").select("a.file_id", "line_no", "text", "names", "fields", "n", "count_at", "time_at")
    split = F.split("text", ",", -1)
    return rows.withColumn("clean", F.coalesce(~F.col("text").contains('"') & (F.size(split) == F.col("n")) & _sound(split, F.col("count_at"), F.col("time_at")), F.lit(False)))


def _edited(rows: DataFrame) -> DataFrame:
    """The parse of the lines that are not clean."""
    r = rows.where("not clean").select("file_id", "line_no", "names", "fields", "text", "n", "count_at", "time_at")
    return r.mapInArrow(_kernel, T.StructType([*r.schema.fields[:4], *_RESULT]))


def parse_lines(lines: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Each body line with its parse:
    file_id, line_no, names, fields, values (one text per column), reason
    (NULL for a good row), quote_edits, delimiter_edits, edits.

    layouts: the result of layouts_of on the same lines, if at hand."""
    rows = _rows(lines, layouts_of(lines) if layouts is None else layouts)
    text = F.col("text")
    tight = F.when(text.contains(" ") | text.contains("\t"), F.regexp_replace(text, r"^[ \t]+|[ \t]+\z|[ \t]*(,)[ \t]*", "$1")).otherwise(text)
    plain = rows.where("clean").select(
        "file_id", "line_no", "names", "fields", F.split(tight, ",", -1).alias("values"),
        F.lit(None).cast("string").alias("reason"), F.lit(0).alias("quote_edits"), F.lit(0).alias("delimiter_edits"), F.lit("").alias("edits"))
    return plain.unionByName(_edited(rows))


def bad_rows(lines: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The lines set apart: file_id, line_no, reason, edits. Clean lines leave
    the plan at their filter."""
    return _edited(_rows(lines, layouts_of(lines) if layouts is None else layouts)).where("reason is not null").select("file_id", "line_no", "reason", "edits")


def good_rows(lines: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The rows that load, typed by the LEAF layout.

    sample_count and sample_time are sound by definition; any other field that
    is no number, is -1.0 or is absent from the file becomes NULL.
    """
    p = parse_lines(lines, layouts).where("reason is null")
    value = lambda f: F.trim(F.get("values", (F.array_position("fields", f) - 1).cast("int")))
    number = lambda f: F.nullif(value(f).try_cast("double"), F.lit(-1.0))
    return p.select(
        "file_id", "line_no", F.regexp_replace(value("sample_count"), r"^\+", "").cast("long").cast("int").alias("sample_count"),
        number("scan_encoder").alias("scan_encoder"), number("rotary_encoder").alias("rotary_encoder"),
        number("range1").alias("range1"), number("intensity1").try_cast("int").alias("intensity1"),
        number("range2").alias("range2"), number("intensity2").try_cast("int").alias("intensity2"),
        value("sample_time").cast("double").alias("sample_time"))

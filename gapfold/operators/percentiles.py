"""Percentiles of very large numeric columns: distributed multi-select.

Each partition, chunk by chunk, proposes local order statistics of every group:
its median, and `proposals` - 1 more evenly spaced ones, so that one round
narrows every wanted rank (`proposals=1` is the textbook form, the median alone).
Put in order and weighted by the rows they stand for, the proposals give, for
every wanted rank, a value certainly below it, the likeliest one (for a median
the weighted median) and one certainly not below it: the pivots. A pass counts
the rows of every group three ways, below, at and above each pivot. A rank that
falls on a pivot is found; else only the open range between two pivots that holds
it goes on, all other rows are discarded, and the rounds repeat until every rank
of every group is found. All groups, levels and ranks advance together, whatever
their size, and the results are exact order statistics (rank error 0).

What moves: proposals (at most `proposals` + 1 values for a chunk and group) and,
in the counting pass, the rows to the pivots of their group, in a sort-merge join
whose hot keys the engine splits. Nothing is broadcast, and only one number a
round (are ranks left?) comes to the driver. The proposals of one group are
merged in a stream whose memory is bounded: past `MERGE_VALUES` they are thinned,
which widens the bounds on ranks but never makes them wrong.

The proposals of a day are also a summary that can be kept: `summaries` makes one
row of at most `SUMMARY_VALUES` values a group, `merge_summaries` puts summaries
of days or parts together and states the rank error, at most RANK_ERROR of the
rows in any group.

Ranks: the p-th permille of n values is the value of rank max(1, ceil(p*n/1000)).
NULL and NaN are left out; a group without values gives no row; NULL keys are a
key; ties and repeated rows count each; infinities order as numbers; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfold.session import Scratch, written

PERMILLES = (10, 50, 250, 500, 750, 950, 990)
PROPOSALS = 127
CHUNK_ROWS = 1 << 17
#: Values of one group's proposals held at once, and left when they are thinned.
MERGE_VALUES, MERGED_VALUES = 1 << 21, 1 << 14
#: Values of a stored summary.
SUMMARY_VALUES = 1024
#: Greatest rank error of merged summaries, as a share of the rows of a group: a
#: chunk of n >= 128 rows leaves n/128 + 1 <= n/64 open, thinning 2/1023 more.
RANK_ERROR = 0.02
_PROPOSED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("base", T.LongType()), *[T.StructField(c, T.ArrayType(t)) for c, t in (("vs", T.DoubleType()), ("low", T.LongType()), ("high", T.LongType()))]])


def local_ranks(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For groups of n sorted rows: group number and 1-based rank of each
    proposal: every row of a group of at most `most`, else `most` evenly spaced
    ones (a single one is the median) and the largest."""
    m = np.minimum(n, most)
    group = np.repeat(np.arange(len(n)), m + 1)
    i = np.arange(len(group)) - np.repeat(np.cumsum(m + 1) - (m + 1), m + 1) + 1
    nn, mm = n[group], m[group]
    rank = np.where(i > mm, nn, np.where(nn <= most, i, np.maximum(1, -(-i * nn // (mm + 1)))))
    same = np.r_[False, (group[1:] == group[:-1]) & (rank[1:] == rank[:-1])]
    return group[~same], rank[~same]


def _codes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Equal numbers for equal keys, NULL being a key."""
    codes = np.zeros(t.num_rows, np.int64)
    for k in keys:
        enc = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(1, len(enc.dictionary)) + enc.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes


def _lists(values: np.ndarray, sizes: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _proposer(levels: list[list[str]], keys: list[str], values: list[str], numbered: bool, most: int, chunk_rows: int):
    """mapInArrow kernel: one row per chunk, level, group and value column."""

    def propose(part: pa.Table):
        for number, own in enumerate(levels):
            _, at, code = np.unique(_codes(part, own), return_index=True, return_inverse=True)
            for c, col in enumerate(values):
                v = part.column(col).combine_chunks().to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(v)
                vv, cc = v[ok], code[ok]
                order = np.lexsort((vv, cc))
                vv, cc = vv[order], cc[order]
                groups, start, n = np.unique(cc, return_index=True, return_counts=True)
                if not len(groups):
                    continue
                g, r = local_ranks(n, most)
                rows = part.select(keys).take(pa.array(at[groups]))
                out = {k: rows.column(k).combine_chunks() if k in own else pa.nulls(len(groups), part.schema.field(k).type) for k in keys}
                if numbered:
                    out |= {"level": pa.array(np.full(len(groups), number, np.int32)), "col": pa.array(np.full(len(groups), c, np.int32))}
                sizes = np.bincount(g, minlength=len(groups))
                none = pa.nulls(len(groups), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out | {"n": pa.array(n.astype(np.int64)), "base": pa.nulls(len(groups), pa.int64()), "vs": _lists(vv[start[g] + r - 1], sizes), "low": none, "high": none})

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield from propose(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from propose(pa.Table.from_batches(held))

    return run


def propose(df: DataFrame, levels: list[list[str]], values: list[str], numbered: bool = True, proposals: int = PROPOSALS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Local order statistics of each chunk: all keys (NULL above their level),
    with numbered=True also level and col (the numbers of the level and of the
    value column); n, vs, and base, low, high (NULL: they follow from n)."""
    keys = list(dict.fromkeys(k for lev in levels for k in lev))
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *([T.StructField(c, T.IntegerType()) for c in ("level", "col")] if numbered else []), *_PROPOSED.fields])
    return df.select(*keys, *values).mapInArrow(_proposer(levels, keys, values, numbered, proposals, chunk_rows), schema)


class _Merged:
    """The proposals of whole groups, in order, with bounds on ranks: at least
    `least` and at most `most` rows of the group are <= v, at most `under` < v."""

    def __init__(self, t: pa.Table, group: np.ndarray, proposals: int):
        n, base = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("n", "base"))
        vs, low, high = (t.column(c).combine_chunks() for c in ("vs", "low", "high"))
        size = vs.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        v, given = vs.flatten().to_numpy(), ~np.isnan(base.astype(float))
        lo, hi = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        first = np.nan_to_num(base.astype(float)).astype(np.int64)
        if (~given).any():
            own = np.flatnonzero(~given)
            g, r = local_ranks(n[own], proposals)
            head = np.r_[True, g[1:] != g[:-1]]
            tail = np.r_[head[1:], True]
            mine = ~given[row]
            lo[mine] = r - np.where(head, 0, np.r_[0, r[:-1]])
            hi[mine] = np.where(tail, 1, np.r_[r[1:], 0] - r)
            first[own] = r[head] - 1
        if given.any():
            lo[given[row]], hi[given[row]] = low.flatten().to_numpy(), high.flatten().to_numpy()
        self.groups = int(group[-1]) + 1
        self.n, self.base = (np.bincount(group, x, self.groups).round().astype(np.int64) for x in (n, first))
        g = group[row]
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        last = np.r_[(g[1:] != g[:-1]) | (v[1:] != v[:-1]), True]
        up = lambda x: np.cumsum(x[order])[last]
        self.g, self.v = g[last], v[last]
        start = np.searchsorted(self.g, np.arange(self.groups))
        lows, highs = up(lo), up(hi)
        before = lambda c: np.r_[0, c][start][self.g]
        self.least = lows - before(lows)
        self.most = highs - before(highs) + self.base[self.g]
        self.start = start
        head = np.zeros(len(self.g), bool)
        head[start] = True
        self.under = np.where(head, self.base[self.g], np.r_[0, self.most[:-1]])

    def find(self, group: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per wanted rank the places of its lower bound (-1: none), likeliest
        value and upper bound."""
        shift = np.cumsum(self.n + 2) - (self.n + 2)
        least, most, want = self.least + shift[self.g], self.most + shift[self.g], k + shift[group]
        hi = np.searchsorted(least, want)
        mid = np.searchsorted(least + most, 2 * want)
        lo = np.searchsorted(most, want) - 1
        return np.where(lo >= self.start[group], lo, -1), mid, hi

    def thinned(self, keep: int) -> tuple[np.ndarray, ...]:
        """sizes, vs, low, high, base of every group with at most `keep` values,
        evenly spaced in rank, the largest among them."""
        # a value stays where its share of the ranks passes a step, or where it is the last
        size = np.bincount(self.g, minlength=self.groups)
        step = self.least * (keep - 1) // np.maximum(self.n[self.g], 1)
        change = np.r_[True, (step[1:] != step[:-1]) | (self.g[1:] != self.g[:-1])]
        end = np.r_[self.g[1:] != self.g[:-1], True]
        stay = np.flatnonzero((size[self.g] <= keep) | change | end)
        g = self.g[stay]
        head = np.r_[True, g[1:] != g[:-1]]
        # rows that may stand up to the next value kept: what may be below it
        nxt = np.r_[self.under[stay[1:]], 0]
        reach = np.where(np.r_[head[1:], True], self.most[stay], nxt)
        low = self.least[stay] - np.where(head, 0, np.r_[0, self.least[stay[:-1]]])
        base = self.under[stay][head]
        high = reach - np.where(head, np.repeat(base, np.bincount(g, minlength=self.groups)), np.r_[0, reach[:-1]])
        return np.bincount(g, minlength=self.groups), self.v[stay], low, high, base


def _whole_groups(batches, group: list[str], proposals: int):
    """Tables of whole groups with their group numbers, from rows sorted by
    group; the rows of a group that goes on are held back, and thinned when they
    hold too many values."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        codes = _codes(t, group)
        number = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
        cut = int(np.searchsorted(number, number[-1])) if len(number) else 0
        if cut:
            yield t.slice(0, cut), number[:cut]
        held = t.slice(cut)
        if sum(len(c.flatten()) for c in held.column("vs").chunks) > MERGE_VALUES:
            held = _shortened(held, np.zeros(held.num_rows, np.int64), proposals, MERGED_VALUES)
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, np.int64)


def _shortened(t: pa.Table, number: np.ndarray, proposals: int, keep: int) -> pa.Table:
    """One row per group, with at most keep + 1 values."""
    m = _Merged(t, number, proposals)
    sizes, vs, low, high, base = m.thinned(keep)
    new = {"n": pa.array(m.n), "base": pa.array(base), "vs": _lists(vs, sizes), "low": _lists(low, sizes, pa.int64()), "high": _lists(high, sizes, pa.int64())}
    first = t.take(pa.array(np.searchsorted(number, np.arange(m.groups))))
    return pa.table([pa.chunked_array([new[c]]).cast(t.schema.field(c).type) if c in new else first.column(c) for c in t.column_names], schema=t.schema)


def _by_group(df: DataFrame, group: list[str]) -> DataFrame:
    """df with the rows of a group together, for the kernels above."""
    return df.repartition(*group).sortWithinPartitions(*group)


def _wanted(t: pa.Table, m: _Merged, number: np.ndarray, permilles: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Group and rank of everything wanted: by the permilles, or as given."""
    if "ks" not in t.column_names:
        group = np.repeat(np.arange(m.groups), len(permilles))
        return group, np.maximum(1, (np.tile(permilles, m.groups) * m.n[group] + 999) // 1000)
    ks = t.column("ks").combine_chunks().take(pa.array(np.searchsorted(number, np.arange(m.groups))))
    return np.repeat(np.arange(m.groups), ks.value_lengths().to_numpy(zero_copy_only=False)), ks.flatten().to_numpy()


def _pivot_kernel(group: list[str], proposals: int, permilles: tuple[int, ...]):
    def run(batches):
        for t, number in _whole_groups(batches, group, proposals):
            m = _Merged(t, number, proposals)
            g, k = _wanted(t, m, number, permilles)
            lo, mid, hi = m.find(g, k)
            sure = m.under[hi] < k  # the upper bound is the value itself
            at = np.unique(np.r_[hi, mid[~sure], lo[~sure & (lo >= 0)]])
            rows = t.select([c for c in t.column_names if c in group or c in ("tags", "ks")]).take(pa.array(np.searchsorted(number, np.arange(m.groups)))).combine_chunks()
            out = {c: rows.column(c).combine_chunks() for c in rows.column_names}
            yield pa.RecordBatch.from_pydict(out | {"total": pa.array(m.n), "pivots": _lists(m.v[at], np.bincount(m.g[at], minlength=m.groups))})

    return run


def _pivots(proposed: DataFrame, group: list[str], proposals: int, permilles: tuple[int, ...]) -> DataFrame:
    """group, total, pivots (and tags, ks, where ranks are given)."""
    kept = [f for f in proposed.schema.fields if f.name in group or f.name in ("tags", "ks")]
    schema = T.StructType([*kept, T.StructField("total", T.LongType()), T.StructField("pivots", T.ArrayType(T.DoubleType()))])
    return _by_group(proposed, group).mapInArrow(_pivot_kernel(group, proposals, permilles), schema)


def _place_kernel(group: list[str], permilles: tuple[int, ...]):
    """Per wanted rank: its value, or the open range that holds it and its rank
    in there."""

    def run(batches):
        for b in batches:
            rows = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lo", "total", "pivots", "counts", *[x for x in ("tags", "ks") if x in b.schema.names])}
            source, tag, k_in, value, start, end = [], [], [], [], [], []
            for i, (total, pivots, counts) in enumerate(zip(rows["total"], rows["pivots"], rows["counts"])):
                asked = zip(rows["tags"][i], rows["ks"][i]) if "tags" in rows else [(p, max(1, (p * total + 999) // 1000)) for p in permilles]
                pos = [c["pos"] for c in counts]
                upto = np.cumsum([c["n"] for c in counts])
                for t, k in asked:
                    j = int(np.searchsorted(upto, k))
                    p = pos[j]
                    found = p % 2 == 1
                    source.append(i)
                    tag.append(t)
                    k_in.append(None if found else k - (int(upto[j - 1]) if j else 0))
                    value.append(pivots[p // 2] if found else None)
                    start.append(None if found else pivots[p // 2 - 1] if p else rows["lo"][i])
                    end.append(None if found or p // 2 == len(pivots) else pivots[p // 2])
            take = pa.array(source, pa.int64())
            keys = {c: b.column(b.schema.get_field_index(c)).take(take) for c in group}
            yield pa.RecordBatch.from_pydict(keys | {"tag": pa.array(tag, pa.int32()), "k": pa.array(k_in, pa.int64()), "value": pa.array(value, pa.float64()),
                                                     "range_lo": pa.array(start, pa.float64()), "range_hi": pa.array(end, pa.float64())})

    return run


def _below(v: Column, a: int, b: int) -> Column:
    """How many pivots are below v, by halving. A list shorter than b is as if
    filled up with values above all."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    return F.when(v > F.get(F.col("pivots"), F.lit(m)), _below(v, m + 1, b)).otherwise(_below(v, a, m))


def _positions(rows: DataFrame, group: list[str], edges: int) -> DataFrame:
    """group and pos, the place of v among the pivots: 2 * (pivots below v) + (1
    if v is one)."""
    at = rows.withColumn("below", _below(F.col("v"), 0, edges))
    return at.select(*group, (2 * F.col("below") + F.coalesce((F.col("v") == F.get("pivots", F.col("below"))).cast("int"), F.lit(0))).alias("pos"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


class _Wide:
    """The rows of the first round, as they come: all value columns side by side,
    met with what concerns them at every level in one join on all keys."""

    def __init__(self, df: DataFrame, levels: list[list[str]], columns: list[str], keys: list[str]):
        self.df, self.levels, self.columns, self.keys = df, levels, columns, keys

    def with_payload(self, groups: DataFrame, group: list[str], payload: list[str], finest: DataFrame) -> DataFrame:
        """group, v and the payload, for every value of a row at every level."""
        items = None
        for number, own in enumerate(self.levels):
            at = groups.where(F.col("level") == number)
            on = _same("f", "g", own)
            one = finest.alias("f").join(at.alias("g").hint("merge"), on).select(*[F.col(f"f.{k}") for k in self.keys], F.struct("g.level", "g.col", *[F.col(f"g.{c}") for c in payload]).alias("item"))
            items = one if items is None else items.unionByName(one)
        side = items.groupBy(*self.keys).agg(F.collect_list("item").alias("items"))
        met = self.df.alias("a").join(side.alias("b").hint("merge"), _same("a", "b", self.keys)).select(*[F.col(f"a.{k}") for k in self.keys], F.array(*[F.col(f"a.v{i}") for i in range(len(self.columns))]).alias("vs"), F.explode("items").alias("item"))
        level = F.col("item.level")
        within = [F.when(level.isin([i for i, own in enumerate(self.levels) if k in own]), F.col(k)).alias(k) for k in self.keys]
        rows = met.select(*within, "item.level", "item.col", F.lit(None).cast("double").alias("lo"), F.get("vs", F.col("item.col")).alias("v"), *[F.col(f"item.{c}").alias(c) for c in payload])
        return rows.where("v is not null and not isnan(v)")


class _Long:
    """The rows of later rounds: one value each, in an open range of its group."""

    def __init__(self, df: DataFrame):
        self.df = df

    def with_payload(self, groups: DataFrame, group: list[str], payload: list[str], finest: DataFrame) -> DataFrame:
        return self.df.alias("a").join(groups.alias("b").hint("merge"), _same("a", "b", group)).select(*[F.col(f"a.{c}") for c in [*group, "v"]], *[F.col(f"b.{c}") for c in payload])


def percentiles(df: DataFrame, levels: list[list[str]], columns: list[str], permilles: tuple[int, ...] = PERMILLES, proposals: int = PROPOSALS, chunk_rows: int = CHUNK_ROWS, log: list | None = None) -> DataFrame:
    """Exact percentiles of each column at each level of grouping, as rows
    (all keys, NULL above their level; level, col, n, permille, value,
    rank_error = 0), by multi-select.

    log: a list that gets the number of open ranks after each round."""
    spark, keys = df.sparkSession, list(dict.fromkeys(k for lev in levels for k in lev))
    scratch = Scratch(spark)
    # zero is added so that -0 and 0 are one number
    wide = df.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])
    group = [*keys, "level", "col", "lo"]
    rows = _Wide(wide, levels, columns, keys)
    proposed = propose(wide, levels, [f"v{i}" for i in range(len(columns))], True, proposals, chunk_rows).withColumn("lo", F.lit(None).cast("double"))
    found, sizes, finest = [], None, None
    while True:
        pivots = written(_pivots(proposed, group, proposals, permilles), "pivots", scratch)
        if sizes is None:
            sizes = pivots
            own = [i for i, lev in enumerate(levels) if set(lev) == set(keys)]
            finest = pivots.where(F.col("level") == own[0]).select(*keys).distinct() if own else wide.select(*keys).distinct()
        edges = pivots.agg(F.max(F.size("pivots"))).first()[0] or 0
        place = _positions(rows.with_payload(pivots, group, ["pivots"], finest), group, edges)
        counts = place.groupBy(*group, "pos").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("counts"))
        both = pivots.alias("a").join(counts.alias("b").hint("merge"), _same("a", "b", group)).select("a.*", "b.counts")
        schema = T.StructType([*[pivots.schema[c] for c in group], T.StructField("tag", T.IntegerType()), T.StructField("k", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("value", "range_lo", "range_hi")]])
        placed = written(both.mapInArrow(_place_kernel(group, permilles), schema), "placed")
        found.append(placed.where("value is not null"))
        left = placed.where("value is null")
        some = left.count()
        if log is not None:
            log.append(some)
        if not some:
            break
        # the open ranges, with the ranks wanted in each; the rows inside go on
        asked = left.groupBy(*group, "range_lo", "range_hi").agg(F.sort_array(F.collect_list(F.struct("k", "tag"))).alias("want"))
        ranges = written(asked.select("*", F.col("want.tag").alias("tags"), F.col("want.k").alias("ks")).drop("want"), "ranges", scratch)
        per_group = ranges.groupBy(*group).agg(F.collect_list(F.struct("range_lo", "range_hi")).alias("ranges"))
        inside = rows.with_payload(per_group, group, ["ranges"], finest).withColumn("r", F.explode("ranges")).where(
            (F.col("r.range_lo").isNull() | (F.col("v") > F.col("r.range_lo"))) & (F.col("r.range_hi").isNull() | (F.col("v") < F.col("r.range_hi"))))
        live = written(inside.select(*keys, "level", "col", F.col("r.range_lo").alias("lo"), "v"), "live", scratch)
        rows = _Long(live)
        ranks = ranges.select(*keys, "level", "col", F.col("range_lo").alias("lo"), "tags", "ks")
        chunks = propose(live, [group], ["v"], False, proposals, chunk_rows)
        proposed = chunks.alias("a").join(ranks.alias("b").hint("merge"), _same("a", "b", group)).select("a.*", "b.tags", "b.ks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    n = written(sizes.select(*keys, "level", "col", F.col("total").alias("n")), "sizes")
    scratch.clear()
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("a.col") + 1)
    return out.alias("a").join(n.alias("b").hint("merge"), _same("a", "b", [*keys, "level", "col"])).select(
        *[F.col(f"a.{k}") for k in keys], F.col("a.level"), name.alias("col"), F.col("b.n"), F.col("a.tag").alias("permille"), F.col("a.value"), F.lit(0.0).alias("rank_error"))


def summaries(df: DataFrame, keys: list[str], columns: list[str], proposals: int = PROPOSALS, chunk_rows: int = CHUNK_ROWS, keep: int = SUMMARY_VALUES) -> DataFrame:
    """One row per group and column that can be stored and merged: keys, col (the
    number of the column), n, base, vs, low, high."""
    wide = df.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])
    proposed = propose(wide, [keys], [f"v{i}" for i in range(len(columns))], True, proposals, chunk_rows).drop("level")
    group = [*keys, "col"]

    def run(batches):
        for t, number in _whole_groups(batches, group, proposals):
            yield from _shortened(t, number, proposals, keep).combine_chunks().to_batches()

    return _by_group(proposed, group).mapInArrow(run, proposed.schema)


def merge_summaries(parts: DataFrame, keys: list[str], columns: list[str], permilles: tuple[int, ...] = PERMILLES, proposals: int = PROPOSALS) -> DataFrame:
    """Percentiles from summaries of any parts put together: keys, col, n,
    permille, value, rank_error (greatest possible error as a share of n; 0 means
    exact; never above RANK_ERROR)."""
    group = [*keys, "col"]

    def run(batches):
        for t, number in _whole_groups(batches, group, proposals):
            m = _Merged(t, number, proposals)
            g, k = _wanted(t, m, number, permilles)
            _, mid, _ = m.find(g, k)
            # the true ranks of the value are somewhere in (under at least .. most]; the wanted one may be off on either side
            err = np.maximum(np.maximum(m.under[mid] + 1 - k, k - m.least[mid]), 0)
            first = t.select(group).take(pa.array(np.searchsorted(number, np.arange(m.groups)))).take(pa.array(g)).combine_chunks()
            yield pa.RecordBatch.from_pydict({c: first.column(c).combine_chunks() for c in group} | {
                "n": pa.array(m.n[g]), "permille": pa.array(np.tile(permilles, m.groups).astype(np.int32)), "value": pa.array(m.v[mid]), "rank_error": pa.array(err / m.n[g])})

    schema = T.StructType([*[parts.schema[c] for c in group], T.StructField("n", T.LongType()), T.StructField("permille", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("rank_error", T.DoubleType())])
    out = _by_group(parts.select(*group, *[f.name for f in _PROPOSED.fields]), group).mapInArrow(run, schema)
    return out.withColumn("col", F.element_at(F.array(*map(F.lit, columns)), F.col("col") + 1))


_XYZ = ["x", "y", "z"]


def _of_points(points: DataFrame) -> DataFrame:
    return points.select("scan_id", F.to_date("loaded_at").alias("day"), *_XYZ)


def point_percentiles(points: DataFrame, log: list | None = None) -> DataFrame:
    """x, y, z of the returns per scan (level 0) and per scan and loading day (level 1)."""
    return percentiles(_of_points(points), [["scan_id"], ["scan_id", "day"]], _XYZ, log=log)


def daily_summaries(points: DataFrame) -> DataFrame:
    """One stored summary of x, y and z each per scan and loading day."""
    return written(summaries(_of_points(points), ["scan_id", "day"], _XYZ), "daily")


def combined_percentiles(points: DataFrame) -> DataFrame:
    """Daily summaries of x, y, z put together per scan, with their rank error."""
    return merge_summaries(daily_summaries(points), ["scan_id"], _XYZ)


def combined_ranks(points: DataFrame) -> DataFrame:
    """combined_percentiles held against the points: scan_id, col, n, permille,
    and whether the true rank of each value is within its stated error and that
    within RANK_ERROR."""
    got = combined_percentiles(points)
    long = points.select("scan_id", F.expr("stack(3, 'x', x, 'y', y, 'z', z) as (col, v)")).where("v is not null and not isnan(v)")
    j = long.alias("a").join(got.alias("b").hint("merge"), _same("a", "b", ["scan_id", "col"])).select("b.*", "a.v")
    c = j.groupBy("scan_id", "col", "n", "permille", "value", "rank_error").agg(F.count_if(F.col("v") < F.col("value")).alias("under"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    k = F.greatest(F.lit(1), F.expr("(permille * n + 999) div 1000"))
    off = F.greatest(F.col("under") + 1 - k, k - F.col("upto"), F.lit(0))
    return c.select("scan_id", "col", "n", "permille", ((off <= F.round(F.col("rank_error") * F.col("n"))) & (F.col("rank_error") <= RANK_ERROR)).alias("within"))

import itertools
import random

import pytest

from gapfold.operators.badrows import align, bad_rows, good_rows, value_edits

NEW = "# Firmware ver.: 4.12"
OLD = "# Firmware ver.: 4.05"


def brute(text: str, n: int) -> tuple[int, int]:
    """Least (quote edits, delimiter edits): all subsets of deleted quotes and
    all places of inserted ones, tried in order of cost."""

    def fields(t):
        out, i = 0, 0
        while True:
            j = i
            while j < len(t) and t[j] in " \t":
                j += 1
            if j < len(t) and t[j] == '"':
                k = t.find('"', j + 1)
                if k < 0:
                    return None
                k += 1
                while k < len(t) and t[k] in " \t":
                    k += 1
                if k < len(t) and t[k] != ",":
                    return None
            else:
                k = i
                while k < len(t) and t[k] != ",":
                    if t[k] == '"':
                        return None
                    k += 1
            out += 1
            if k >= len(t):
                return out
            i = k + 1

    seen = {text}
    for cost in range(5):
        got = [f for t in seen if (f := fields(t)) is not None]
        if got:
            return cost, min(abs(f - n) for f in got)
        seen = {t[:i] + t[i + 1 :] for t in seen for i, c in enumerate(t) if c == '"'} | {t[:i] + '"' + t[i:] for t in seen for i in range(len(t) + 1)}
    raise AssertionError(text)


def test_alignment_matches_brute_force():
    rng = random.Random(5)
    lines = ["".join(rng.choice('1,"" ,a') for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lines = [t for t in lines if t.count('"') <= 4]
    got = align(lines, 3)
    for line, (quotes, delims, _, fields) in zip(lines, got):
        want = brute(line, 3)
        assert (quotes > 0) == (want[0] > 0), line
        assert quotes == want[0], (line, quotes, want)
        if not quotes:
            assert delims == want[1], (line, delims, want)
        assert len(fields) == 3


@pytest.mark.parametrize(("count", "time", "bad"), [
    ("1", "2.5", 0), ("+01", "+.5", 0), (" 7 ", "5.", 0), ("2147483647", "1e3", 0), ("0", "0", 0), ("0000000000000000000012", "1E-3", 0),
    ("2147483648", "1", 1), ("-1", "1", 1), ("1.0", "1", 1), ("", "1", 1), ("++1", "1", 1), ("٣", "1", 1), ("1e2", "1", 1),
    ("1", "", 1), ("1", "-1.0", 1), ("1", "inf", 1), ("1", "nan", 1), ("1", "1e999", 1), ("1", ".", 1), ("1", "1,5", 1), ("1", "0x1", 1), ("x", "y", 2),
])
def test_values(count, time, bad):
    assert len(value_edits([count, time], 0, 1)) == bad


def _lines(spark, files):
    rows = [(f, i, t) for f, ls in files.items() for i, t in enumerate(ls, 1)]
    return spark.createDataFrame(rows, "file_id long, line_no int, line_text string")


def reasons(df):
    return {(r.file_id, r.line_no): r.reason for r in bad_rows(df).collect()}


def test_reasons(spark):
    files = {
        1: [NEW, "0,6400,100,5.5,100,-1.0,0,12.5", '"1"," 6410 " ,100,5.6,90,7.2,40,"12.5"\r', "2,6420,100,5.6", '3,64"10,100,5.6,90,7.2,40,12.5', "# note: a,b", "", "   ", "x,1,1,1,1,1,1,1", '4,1,1,"1,5",1,1,1,1', None, "5,1,1,1,1,1,1,-1.0"],
        2: [OLD, "0,6400,100,5.5,100,-1.0,12.5", "1,6400,100,5.5,100,-1.0,40,12.5"],
        3: [OLD, "#cols: sample_time ; sample_count;range1;rotary_encoder", "12.5,0,1,1", "0,12.5,1,1"],
        4: ["0,1,2,3,4,5,6", "#Fields: sample_count,range1,sample_time"],
        5: ["# Fields: sample_count | range1 | sample_time", '"0', '0,",1', "1,2,3", '0,"1"x,2'],
    }
    assert reasons(_lines(spark, files)) == {
        (1, 4): "columns", (1, 5): "quoting", (1, 9): "value", (1, 12): "value", (2, 3): "columns", (3, 4): "value", (5, 2): "quoting", (5, 3): "quoting", (5, 5): "quoting"}


def test_good_rows(spark):
    df = _lines(spark, {1: [NEW, '+3,"6400",-1.0,5.5,0x1,,7,1e1']})
    r = good_rows(df).first()
    assert (r.sample_count, r.scan_encoder, r.rotary_encoder, r.range1, r.intensity1, r.range2, r.intensity2, r.sample_time) == (3, 6400.0, None, 5.5, None, None, 7, 10.0)


def test_edges(spark):
    empty = spark.createDataFrame([], "file_id long, line_no int, line_text string")
    assert bad_rows(empty).count() == 0 and good_rows(empty).count() == 0
    df = _lines(spark, {None: [OLD, "0,1,2,3,4,5,6", "0,1"], 7: [OLD, "0,1,2,3,4,5,6", "0,1", "0,1"]})
    clash = df.selectExpr("*", "'x' as text", "1 as n", "'y' as names", "2 as p", "3 as fields", "4 as reason", "5 as clean")
    got = bad_rows(clash).collect()
    assert sorted((r.file_id or 0, r.line_no, r.reason) for r in got) == [(0, 3, "columns"), (7, 3, "columns"), (7, 4, "columns")]


def test_very_long_line(spark):
    long = "0," + "9" * 200_000 + ',1,2,3,4,"' + "a," * 50_000
    df = _lines(spark, {1: [OLD, long, "1," * 60_000, "1,2,3,4,5,6,7"]})
    assert reasons(df) == {(1, 2): "quoting", (1, 3): "columns"}


def test_batches_are_cut(monkeypatch):
    from gapfold.operators import badrows

    lines = ["".join(x) for x in itertools.product('1,"', repeat=4)]
    whole = [r[:2] for r in align(lines, 2)]
    monkeypatch.setattr(badrows, "TRACE_CELLS", 64)
    assert [align([x], 2)[0][:2] for x in lines] == whole


def test_missing_delimiters_at_seams():
    got = align(["1,2,100-1.0,4", "1,2,3.5.6,4", "1,2 80,3,4", "1,2,3", "1,23,4,5", "1,x-1,3,4", '1,"2" 80,3,4'], 5)
    assert [g[2] for g in got[:6]] == [["insert delimiter before 8"], ["insert delimiter before 8"], ["insert delimiter before 5"], ["insert 2 delimiter(s) at end"], ["insert 1 delimiter(s) at end"], ["insert 1 delimiter(s) at end"]]
    assert got[0][3] == ["1", "2", "100", "-1.0", "4"] and got[2][3] == ["1", "2", "80", "3", "4"]
    assert [g[0] for g in got] == [0] * 6 + [2]  # no delimiter is put beside a quote


def test_trace_in_blocks():
    rng = random.Random(7)
    lines = ["".join(rng.choice('1,"" ,a.-') for _ in range(rng.randint(1, 400))) for _ in range(30)]
    assert align(lines, 6, cells=1) == align(lines, 6)

import os
import random

import pytest

from gapfold.operators import compaction as c

SCHEMA = "fragment_id long, serial_number string, scan_count int, body string"


def test_surplus(spark):
    df = spark.createDataFrame([
        (1, "A", 1, "# h\r\n0,1.50,2\r\n1,2\n\n 0 , \"1.5\", +2.0 "),
        (2, "A", 1, "0,1.5,2,\n0,1.5,2\r"),
        (3, "A", 2, "0,1.5,2"),
        (4, "B", 1, "-0,x\n0, x\n0,y"),
        (5, None, None, "7\n7"),
        (6, "A", 1, None), (7, "A", 1, ""), (8, "A", 1, "#only"),
    ], SCHEMA)
    got = sorted((r.fragment_id, r.line_no) for r in c.surplus_records(df).collect())
    assert got == [(1, 5), (2, 2), (4, 2), (5, 2)]
    kept = sorted((r.fragment_id, r.line_no) for r in c.sorted_out(df).where("times is not null").collect())
    assert kept == [(1, 2), (1, 3), (2, 1), (3, 1), (4, 1), (4, 3), (5, 1)]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.surplus_records(empty).count() == 0
    long = "1," * 100_000 + "1"
    df = spark.createDataFrame([(1, "A", 1, long + "\n" + long), (None, "A", 1, "5"), (2, "A", 1, "5")], SCHEMA)
    clash = df.selectExpr("*", "'k' as key", "1 as pos", "'r' as record", "2 as line_no", "3 as place", "4 as times", "5 as part")
    assert sorted(((r.fragment_id or 0), r.line_no) for r in c.surplus_records(clash).collect()) == [(1, 2), (2, 1)]
    assert c.surplus_records(df.unionAll(df)).count() == 2  # repeated rows count once
    with pytest.raises(RuntimeError):  # two bodies under one id have no places of their own
        c.surplus_records(spark.createDataFrame([(1, "A", 1, "5"), (1, "A", 1, "6")], SCHEMA))


NUMBERS = [
    ("1.50", "1.5"), ("+2.0", "2"), ("-0", "0"), ("-0.00", "0"), ("007", "7"), (".5", "0.5"), ("5.", "5"), ("-.50", "-0.5"), ("1e3", "1000"), ("1.5E+2", "150"), ("12e-1", "1.2"), ("12e-4", "0.0012"),
    ("0e9", "0"), ("1e0", "1"), ("9007199254740993", "9007199254740993"), ("9007199254740992", "9007199254740992"), ("0.1000000000000000055511151231257827", "0.1000000000000000055511151231257827"),
    ("1d", "'1d"), ("1f", "'1f"), ("0x1p3", "'0x1p3"), ("NaN", "'NaN"), ("", "'"), (".", "'."), ("1e", "'1e"), ("--1", "'--1"), ("1e999", "1e999"), ("10e998", "1e999"), ("1e-999", "1e-999"), ("100", "100"), ("1 0", "'1 0"),
]


def test_exact_numbers(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS], "t string")
    assert [r[0] for r in df.select(c.exact_number(c.F.col("t"))).collect()] == [w for _, w in NUMBERS]


def test_short_way_says_the_same(spark):
    rng = random.Random(3)
    lines = [",".join("".join(rng.choice("0012.-") for _ in range(rng.randint(1, 7))) for _ in range(3)) for _ in range(4000)] + ["0.000,10.10,-0.0,00.5,-.0,100,.10"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    quoted = c.F.concat(c.F.lit(" "), c.F.col("t"))  # a blank sends the line the general way
    bad = df.where(c.record_numbers(c.F.col("t")) != c.record_numbers(quoted)).collect()
    assert not bad


def test_records_equal_only_as_exact_numbers(spark):
    df = spark.createDataFrame([(1, "A", 1, "1d,2\n1,2\n9007199254740993,1\n9007199254740992,1\n1e0,2.000")], SCHEMA)
    assert [(r.fragment_id, r.line_no) for r in c.surplus_records(df).collect()] == [(1, 5)]


def test_hot_record(spark):
    df = spark.range(0, 3000).selectExpr("id as fragment_id", "'A' as serial_number", "1 as scan_count", "case when id % 3 = 0 then '1,2' else concat(id + 10, ',2') end as body")
    assert c.surplus_records(df).count() == 999


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(i, "A", 1, f"{i % 5},1\n#x") for i in range(40)], SCHEMA).repartition(8)
    out = f"file://{tmp_path}/out"
    assert c.compact_fragments(df, out) == {"files_in": 40, "bytes_in": 240, "records": 5, "files_out": 1}
    assert spark.read.parquet(f"{out}/log").count() == 35
    assert not os.path.exists(f"{tmp_path}/out.staged")
    with pytest.raises(FileExistsError):
        c.compact_fragments(df, out)


def test_directory(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(60):
        (src / f"{i}.txt").write_text("".join(f"{i},{j}\n" for j in range(i % 4)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    r = c.compact_directory(spark, f"file://{src}", f"file://{tmp_path}/out", "text", c.Packing(target_bytes=400, open_cost=1))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert r["files_in"] == 60 and r["records"] == sum(i % 4 for i in range(60)) and 1 <= r["files_out"] <= 3
    got = sorted(x.value for x in spark.read.text(f"file://{tmp_path}/out").collect())
    assert got == sorted(f"{i},{j}" for i in range(60) for j in range(i % 4))
    assert not os.path.exists(f"{tmp_path}/out.staged")


def test_bad_output_is_refused(spark, tmp_path, monkeypatch):
    df = spark.range(10).toDF("a")
    calls = iter([(10, 1), (9, 1)])
    monkeypatch.setattr(c, "checksum", lambda d: next(calls))
    with pytest.raises(RuntimeError):
        c.write_verified(df, f"file://{tmp_path}/out", 1)
    assert not os.path.exists(f"{tmp_path}/out") and not os.path.exists(f"{tmp_path}/out.staged")


def test_failed_rename_is_told(spark, tmp_path, monkeypatch):
    real = c.file_system

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda *a: False) if name == "rename" else getattr(self.fs, name)

    monkeypatch.setattr(c, "file_system", lambda spark, path: (lambda p, fs: (p, Stuck(fs)))(*real(spark, path)))
    with pytest.raises(RuntimeError):
        c.write_verified(spark.range(3).toDF("a"), f"file://{tmp_path}/a", 1)
    with pytest.raises(RuntimeError):
        c.compact_fragments(spark.createDataFrame([(1, "A", 1, "1")], SCHEMA), f"file://{tmp_path}/b")
    assert not os.path.exists(f"{tmp_path}/a") and not os.path.exists(f"{tmp_path}/b")


@pytest.mark.parametrize("lossy", ["fragment_records", "sorted_out"])
def test_lost_record_is_refused(spark, tmp_path, monkeypatch, lossy):
    df = spark.createDataFrame([(1, "A", 1, "1,1\r\n2,1\n"), (2, "A", 1, "#x\n \t\n2.0,1\n3,1"), (3, None, None, "3,1")], SCHEMA)
    assert c.compact_fragments(df, f"file://{tmp_path}/all")["records"] == 4
    whole = getattr(c, lossy)
    monkeypatch.setattr(c, lossy, lambda f: whole(f).where("record <> '1,1'"))
    with pytest.raises(RuntimeError):
        c.compact_fragments(df, f"file://{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") and not os.path.exists(f"{tmp_path}/out.staged")

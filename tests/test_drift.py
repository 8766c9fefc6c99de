from pyspark.sql import functions as F

from gapfold.operators.drift import change_log, unified_rows

OLD = "# Firmware ver.: 4.05"
FILES = "file_id long, file_name string, serial_number string, scan_count int, datetime timestamp_ntz"


def data(spark, files, lines):
    f = spark.createDataFrame([(i, n, s, c, None if t is None else t) for i, n, s, c, t in files], "file_id long, file_name string, serial_number string, scan_count int, t string").withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    rows = [(f_, i, t) for f_, ls in lines.items() for i, t in enumerate(ls, 1)]
    return spark.createDataFrame(rows, "file_id long, line_no int, line_text string"), f


def test_changes(spark):
    files = [
        (1, "a", "S", 1, "2025-01-01 00:00:00"), (2, "b", "S", 2, "2025-01-02 00:00:00"), (3, "c", "S", 3, "2025-06-02 00:00:00"),
        (4, "d", "S", 4, "2025-06-03 00:00:00"), (5, "c", "S", 3, "2025-06-02 00:00:00"), (6, "x", "T", 1, "2025-01-01 00:00:00"),
    ]
    lines = {
        1: [OLD, "0,6400,1,1,1,1,10"],
        2: [OLD, "# Fields: sample_count,scan_enc,rotary_encoder,range1,intensity1,range2,int2,sample_time", "0,6400.5,1,1,1,1,-1.0,10", "1,abc,1,1"],
        3: [OLD, "# cols: sample_time | sample_count | scan_enc | range1 | intensity1 | amp2", "10,0,0x12,1,1,4"],
        4: [OLD, "#fields: sample_count;range1;intensity1;amp2;sample_time", "0,1,1,4.5,1"],
        5: [OLD, "0,1,1,1,1,1,10"],
        6: [OLD, "0,1,1,1,1,1,10"],
    }
    got = {(r.scan_count, r.field_name, r.change_kind) for r in change_log(*data(spark, files, lines)).collect()}
    assert got == {
        (2, "intensity2", "added"), (2, "scan_encoder", "renamed"), (2, "scan_encoder", "retyped"),
        (3, "intensity2", "renamed"), (3, "scan_encoder", "retyped"), (4, "scan_encoder", "removed"), (4, "intensity2", "retyped")}


def test_union_schema(spark):
    lines, _ = data(spark, [(1, "a", "S", 1, None)], {1: [OLD, "0,6400,1,1.5,1,-1.0,10"], 2: [OLD, "# f: sample_count,scan_encoder,range1,sample_time", "7,0x1,2,1e1", "bad"]})
    u = unified_rows(lines)
    kinds = dict(u.dtypes)
    assert (kinds["scan_encoder"], kinds["range1"], kinds["sample_count"]) == ("string", "double", "bigint")
    rows = {r.file_id: r for r in u.collect()}
    assert rows[1].range1 == 1.5 and rows[1].range2 is None and rows[2].range1 == 2.0 and rows[2].scan_encoder == "0x1" and rows[2].rotary_encoder is None


def test_union_of_unknown_wide_and_exponent_columns(spark):
    files = {
        1: [OLD, "# f: sample_count,scan_encoder,range1,sample_time,temperature,line_no", "1,5,99999999999999999999,1e1,20,7", "2,6,3,2.5,-1.0,8"],
        2: [OLD, "# f: sample_count,frequency2,range2,temperature,rotary_encoder,sample_time", "3,1.5,2.25,20.5,123456789012345678,1e-3"],
        3: [OLD, "# f: sample_count,humidity,range2,sample_time", "4,0.1234567890123456789,1e400,5"],
    }
    lines, _ = data(spark, [], files)
    u = unified_rows(lines)
    kinds = dict(u.dtypes)
    assert kinds == {
        "file_id": "bigint", "line_no": "int", "sample_count": "bigint", "scan_encoder": "bigint", "rotary_encoder": "bigint", "range1": "decimal(38,0)", "intensity1": "bigint", "range2": "string",
        "intensity2": "bigint", "sample_time": "double", "temperature": "double", "line_no_": "bigint", "frequency2": "double", "humidity": "string"}
    rows = {r.sample_count: r for r in u.collect()}
    assert str(rows[1].range1) == "99999999999999999999" and rows[1].sample_time == 10.0 and rows[1].temperature == 20.0 and rows[1].intensity2 is None
    assert rows[2].temperature is None and rows[3].frequency2 == 1.5 and rows[3].temperature == 20.5 and rows[3].rotary_encoder == 123456789012345678 and rows[3].range2 == "2.25"
    assert rows[4].humidity == "0.1234567890123456789" and rows[4].range2 == "1e400"


def test_edges(spark):
    lines, files = data(spark, [(1, "a", None, None, "2025-01-01 00:00:00"), (2, "b", None, 2, "2025-01-01 00:00:00"), (3, None, "S", 3, None), (4, "nolines", "S", 4, "2025-01-01 00:00:00")],
                        {1: [OLD, "0,1,1,1,1,1,10"], 2: ["# Firmware ver.: 4.2", "0,1,1,1,1,1,1,10", None], 3: [OLD]})
    clash = files.selectExpr("*", "'q' as name", "1 as level", "true as here", "'z' as prev", "2 as x")
    got = [(r.serial_number, r.scan_count, r.field_name, r.change_kind) for r in change_log(lines.selectExpr("*", "1 as names", "2 as fields"), clash).collect()]
    assert got == [(None, 2, "intensity2", "added")]
    assert change_log(lines.limit(0), files).count() == 0 and change_log(lines, files.limit(0)).count() == 0
    assert unified_rows(lines.limit(0)).count() == 0

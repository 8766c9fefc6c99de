import pytest
from pyspark.sql import functions as F

from gapfold.sources import leaf_files, sinks
from gapfold.streaming import dropfolder

NAME = "TLF00001_0007_hemi_20250203-040506Z_0800_0400.csv"
BODY = "# Firmware ver.: 4.12\n# Tilt: (12, 30, 1000)\n# GPS 1,2,3\n0,6400,100,5.5,100,-1.0,0,12.5\r\n1,6410,100,5.6,90,7.2,40,12.5\n2,6420,100,5.6\n# Batt: 12.5 V\n# Finished 101.8 s\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / NAME).write_text(BODY)
    return tmp_path / "in"


def test_names(spark):
    d = spark.createDataFrame([(NAME,), ("x.csv",), (None,)], "file_name string")
    r = leaf_files.parse_file_names(d).collect()
    assert (r[0].serial_number, r[0].scan_count, r[0].scan_type, str(r[0].datetime), r[0].zenith_shots, r[0].azimuth_shots) == ("TLF00001", 7, "hemi", "2025-02-03 04:05:06", 800, 400)
    assert r[1].serial_number is None and r[2].scan_count is None


def test_scan_and_meta(spark, folder):
    rows = leaf_files.read_scans(spark, str(folder)).orderBy("line_no").collect()
    assert [(r.sample_count, r.range2, r.scan_type) for r in rows] == [(0, None, "hemi"), (1, 7.2, "hemi")]
    m = {(r.section, r.key): r.value for r in leaf_files.meta(leaf_files.read_lines(spark, str(folder))).collect()}
    assert m == {("header", "Firmware ver."): "4.12", ("header", "Tilt"): "(12, 30, 1000)", ("header", "GPS"): "1,2,3", ("footer", "Batt"): "12.5", ("footer", "Finished"): "101.8"}


def test_power(spark, tmp_path):
    (tmp_path / "TLF00001_pwr_20250203.csv").write_text("20250203-040506,12.1,0.5,20.0,55.0\n20250203-040506,12.1,0.5,20.0,55.0\n20250203-050506,12.1,0.5\n")
    r = leaf_files.read_power(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].serial_number == "TLF00001" and str(r[0].datetime) == "2025-02-03 04:05:06" and r[0].humidity == 55.0


def test_drop_folder(spark, folder, tmp_path):
    def run():
        dropfolder.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out/rows")).count(), spark.read.parquet(str(tmp_path / "out/rejects")).count()

    assert run() == (2, 1)
    assert run() == (2, 1)
    (folder / NAME.replace("0007", "0008")).write_text(BODY)
    assert run() == (4, 2)


def test_power_windows(spark, tmp_path):
    d = spark.createDataFrame([("a", "2025-01-01 00:10:00", 12.0, 5.0), ("a", "2025-01-01 00:50:00", 10.0, 7.0)], "serial_number string, t string, battery_voltage double, temperature double").selectExpr("serial_number", "cast(t as timestamp) as datetime", "battery_voltage", "temperature")
    d.write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "p"))
    q = dropfolder.windowed_power(s).writeStream.outputMode("complete").format("memory").queryName("power").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.battery_voltage, r.n) for r in spark.sql("select * from power").collect()] == [(11.0, 2)]


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 1, 2.0, 1)], "z int, y int, x int, value double, cnt long")
    sinks.write_grid(g, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).columns == ["band", "row", "col", "value", "cnt"]
    a = sinks.dense(g, 2, 2)
    assert a.shape == (1, 2, 2) and a[0, 0, 1] == 2.0 and a[0, 1, 1] == sinks.NODATA
    sinks.write_profiles(spark.createDataFrame([(0.5, 1.0), (0.0, 2.0)], "Height double, PAI double"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().split()
    assert text == ["Height,PAI", "0.00000,2.00000", "0.50000,1.00000"]
    v = spark.range(5).select(F.lit("s").alias("scan_id"), F.col("id").cast("int").alias("z"))
    sinks.write_voxels(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("scan_id = 's' and z = 3").count() == 1
    with pytest.raises(ValueError):
        sinks.dense(g, 10_000, 10_000)

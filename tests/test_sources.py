import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds
from stratamesh.operators.clip import ClipArea
from stratamesh.operators.transforms import LocalFrame
from stratamesh.plans.config import Settings, parse_settings
from stratamesh.plans.facade import ChangeDetector
from stratamesh.plans.workflow import compare_epochs, save
from stratamesh.sources import las, rasters, sinks
from stratamesh.sources.points import discover, distance_column, epsg_of, histogram_csv, load_dataset, scan_points, synthetic
from stratamesh.streaming.elevation import arriving_points, running_dod


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    pts = synthetic(spark, 40, 40, keep=0.5, seed=4).withColumn("distance", F.col("z") / 10)
    n = pts.count()
    files = las.write(pts.repartition(3), str(tmp_path / "out"))
    got = spark.read.format("las").option("chunk", 100).load(str(tmp_path / "out"))
    assert files == 3 and got.count() == n
    a = sorted((r["x"], r["y"], round(r["z"], 3)) for r in pts.collect())
    b = sorted((round(r["x"], 3), round(r["y"], 3), round(r["z"], 3)) for r in got.collect())
    assert np.allclose(a, b, atol=2e-3)
    assert got.agg(F.max(F.abs(F.col("z") / 10 - F.col("distance")))).first()[0] < 2e-4
    head = las.read_header(next(str(p) for p in (tmp_path / "out").iterdir()))
    assert head["version"] == "1.4" and head["point_format"] == 6
    with pytest.raises(ValueError):
        las.read_header("x.txt")
    with pytest.raises(FileNotFoundError):
        las.read_header(str(tmp_path / "none.las"))


def test_discovery_and_scan(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    for area, period, seed in (("a", "2015", 1), ("a", "2020", 2), ("b", "2020", 3)):
        synthetic(spark, 30, 30, keep=0.5, seed=seed).coalesce(1).write.parquet(f"{base}/{area}/{period}/data")
    found = discover(spark, base)
    assert [(r["area"], r["time_period"]) for r in found.collect()] == [("a", "2015"), ("a", "2020"), ("b", "2020")]
    assert discover(spark, base, area="b").count() == 1 and discover(spark, f"{base}/x").count() == 0
    data = load_dataset(spark, found.where("area = 'a'"), per_file=50)
    assert data.count() == 100
    paths = [r["path"] for r in found.collect()]
    plan = scan_points(spark, paths, box=Bounds(-5, -5, 5, 5), frame=LocalFrame(1.0, 2.0))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "EqualTo(classification,2)" in text and "GreaterThanOrE" in text and "epoch" not in text.split("ReadSchema")[1].split(">")[0]
    assert scan_points(spark, paths, columns=("x", "file")).select("file").distinct().count() == 3
    sinks.clip_files(data, ClipArea.box(Bounds(-5, -5, 5, 5)), f"{base}/clipped")
    sinks.transform_files(data, [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], f"{base}/moved", LocalFrame(3.0, 4.0))
    assert spark.read.parquet(f"{base}/moved").count() == 100
    sinks.write_text(spark, f"{base}/t.txt", "a\nb")
    assert sinks.read_text(spark, f"{base}/t.txt") == "a\nb"


def test_small_readers(spark, tmp_path):
    wkt = 'PROJCS["x",GEOGCS["g",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25833"]]'
    df = spark.createDataFrame([(wkt,), ('PROJCRS["x",ID["EPSG",25832]]',), ("none",), (None,)], "w string")
    assert [r[0] for r in df.select(epsg_of(F.col("w"))).collect()] == [25833, 25832, None, None]
    assert "25833" in sinks.wkt_of(25833)
    (tmp_path / "h.csv").write_text("Class;Value;Class start;Class end\n0;5;-1.0;0.0\n1;7;0.0;1.0\n")
    assert [r["centre"] for r in histogram_csv(spark, str(tmp_path / "h.csv")).collect()] == [-0.5, 0.5]
    assert distance_column(spark.createDataFrame([(1.0, 2.0)], "x double, m3c2_distance double")).first()["distance"] == 2
    with pytest.raises(ValueError):
        distance_column(df)


def test_las_pushes_conditions(tmp_path):
    from pyspark.sql import datasource as ds

    out = las._File(str(tmp_path / "a.las"), [], None, 0.01)
    out.add({"x": np.arange(10.0), "y": np.arange(10.0), "z": np.zeros(10), "classification": np.arange(10)})
    out.close()
    reader = las.LasReader({"path": str(tmp_path), "chunk": "4"})
    left = list(reader.pushFilters([ds.GreaterThanOrEqual(("x",), 3.0), ds.In(("classification",), (2, 5, 7)), ds.IsNotNull(("x",)), ds.EqualTo(("file",), "a.las")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column(las.NAMES.index("x")).to_pylist()]
    assert got == [5.0, 7.0]
    far = las.LasReader({"path": str(tmp_path)})
    assert not list(far.pushFilters([ds.LessThan(("y",), -5.0)])) and [p.n for p in far.partitions()] == [0]
    with pytest.raises(FileNotFoundError):
        las.LasReader({"path": str(tmp_path / "no*.las")})


@pytest.mark.parametrize("fmt", [0, 1, 2, 3, 6, 7, 8])
def test_las_attributes(fmt):
    """A record of every point format, its fields set one by one."""
    raw = np.zeros((1, las._LENGTH[fmt]), np.uint8)
    raw[0, :12] = np.array([100, -200, 300], "<i4").view(np.uint8)
    raw[0, 12:14] = np.array([7], "<u2").view(np.uint8)
    if fmt < 6:
        raw[0, 14], raw[0, 15], raw[0, 16], raw[0, 17] = 2 | 3 << 3 | 1 << 6 | 1 << 7, 5 | 1 << 6, 256 - 11, 9
        raw[0, 18:20] = np.array([77], "<u2").view(np.uint8)
        want = {"return_number": 2, "number_of_returns": 3, "scan_direction_flag": 1, "edge_of_flight_line": 1, "classification": 5, "synthetic": 0, "key_point": 1, "withheld": 0, "scan_angle": -11.0}
    else:
        raw[0, 14], raw[0, 15], raw[0, 16], raw[0, 17] = 2 | 3 << 4, 1 | 4 | 1 << 7, 64, 9
        raw[0, 18:20], raw[0, 20:22] = np.array([-1000], "<i2").view(np.uint8), np.array([77], "<u2").view(np.uint8)
        want = {"return_number": 2, "number_of_returns": 3, "scan_direction_flag": 0, "edge_of_flight_line": 1, "classification": 64, "synthetic": 1, "key_point": 0, "withheld": 1, "scan_angle": -6.0}
    if fmt in las._GPS:
        raw[0, las._GPS[fmt] : las._GPS[fmt] + 8] = np.array([12.5]).view(np.uint8)
        want["gps_time"] = 12.5
    if fmt in las._COLOURS:
        raw[0, las._COLOURS[fmt] : las._COLOURS[fmt] + 6] = np.array([1, 2, 3], "<u2").view(np.uint8)
        want |= {"red": 1, "green": 2, "blue": 3}
    head = {"path": "x/a.las", "point_format": fmt, "record": las._LENGTH[fmt], "scales": (0.01, 0.01, 0.01), "offsets": (0, 0, 10)}
    got = las.batch_of(head, raw, 5).to_pylist()[0]
    assert {k: got[k] for k in want} == pytest.approx(want) and (got["file"], got["point_id"], got["intensity"], got["user_data"], got["point_source_id"]) == ("a.las", 5, 7, 9, 77)
    assert (got["x"], got["y"], got["z"], got["distance"]) == (1.0, -2.0, 13.0, None)
    assert set(las.dimensions(fmt)) == {k for k, v in got.items() if v is not None} - {"file", "point_id"}


def test_las_files_stay_small(spark, tmp_path):
    pts = synthetic(spark, 40, 40, keep=1.0).withColumn("odd", F.col("point_id") % 2 == 1)
    assert las.write(pts.coalesce(1), str(tmp_path / "o"), extra=["odd"], wkt=sinks.wkt_of(25832), per_file=600) == 3
    names = sorted(str(p) for p in (tmp_path / "o").iterdir())
    assert [las.read_header(n)["n_points"] for n in names] == [600, 600, 400] and "25832" in las.wkt_in(names[0])
    assert las.headers(spark, names).select(F.sum("n_points")).first()[0] == 1600
    with pytest.raises(Exception, match="too far apart"):
        las.write(pts.withColumn("x", F.col("x") * 1e9), str(tmp_path / "far"))


def test_rasters():
    v = np.array([[1.5, np.nan, 3.0], [4.0, 5.0, np.nan]])
    for epsg in (None, 25833, 4326):
        got, left, top, cell = rasters.decode_tiff(rasters.encode_tiff(v, 100.0, 50.0, 2.0, epsg))
        assert np.array_equal(got, v, equal_nan=True) and (left, top, cell) == (100.0, 50.0, 2.0)
    with pytest.raises(ValueError):
        rasters.decode_tiff(b"MM\0*")


def test_shapefiles():
    area = ClipArea.of([[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 4), (4, 4), (4, 2)]], [[(20, 0), (20, 5), (25, 5)]])
    back = ClipArea.from_shapefile(area.to_shapefile())
    assert back.area == area.area and back.bounds == area.bounds and [len(p) for p in back.polygons] == [2, 1]
    with pytest.raises(ValueError):
        ClipArea.from_shapefile(b"x" * 200)


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from stratamesh import staging

    held = staging.staged(spark.range(3), "t")
    assert held.count() == 3
    staging.unstage(held, spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|not_exist"):
        held.count()

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        staging.stage_dir(Cluster)
    with pytest.raises(ValueError):
        staging.mounted("hdfs://host/a")
    assert staging.mounted("file:///a/b") == "/a/b" and staging.mounted("/a") == "/a"


def test_settings():
    assert parse_settings(None) == Settings() and parse_settings(" ") == Settings()
    s = parse_settings(json.dumps({"dod": {"cell": 2.0}, "c2c": {"reach": None}, "seed": 3}))
    assert (s.dod.cell, s.c2c.reach, s.seed) == (2.0, None, 3)
    for bad in ('{"dod": {"cell": "x"}}', '{"nope": 1}', "[1]", '{"dod": 3}'):
        with pytest.raises(ValueError):
            parse_settings(bad)
    assert sum(not k.startswith("_") for k in vars(ChangeDetector)) == 15


def test_workflow(spark, tmp_path):
    a = synthetic(spark, 60, 60, keep=0.6, seed=1)
    b = synthetic(spark, 60, 60, keep=0.6, seed=2, features=[("mound", 0.8, 10, 10, 6)]).withColumn("x", F.col("x") + 0.2)
    s = Settings()
    s.coarse.enabled, s.icp.iterations, s.dod.cell, s.m3c2.core_count, s.c2c.reach = True, 3, 5.0, 40, 3.0
    out = compare_epochs(a, b, s, ClipArea.box(Bounds(-25, -25, 25, 25)))
    assert math.isfinite(out.rmse) and out.dod.count() > 50
    assert out.c2c_stats.first()["n"] > 500 and out.m3c2.count() == 40
    assert len(save(out, f"{tmp_path}/out")) == 6
    with pytest.raises(ValueError):
        compare_epochs(a.limit(0), b, s)


def test_streaming(spark, tmp_path):
    a, b = synthetic(spark, 30, 30, epoch="t1", seed=1), synthetic(spark, 30, 30, epoch="t2", seed=2)
    pts = a.unionByName(b)
    pts.repartition(5).write.parquet(f"{tmp_path}/in")
    box = Bounds(-15, -15, 15, 15)
    q = running_dod(arriving_points(spark, f"{tmp_path}/in", pts.schema, 2), box, 5.0).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    from stratamesh.operators.grid import dod

    want = {(r["cell_x"], r["cell_y"]): r["dod"] for r in dod(a, b, 5.0, box, clamp=False).collect()}
    got = {(r["cell_x"], r["cell_y"]): r["dod"] for r in spark.table("running").collect() if r["dod"] is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)

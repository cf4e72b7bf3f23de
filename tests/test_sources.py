"""Product names and units, points in polygons, nearest times."""

import datetime as dt
import json
import math

import pytest

from skysieve.operators import regions
from skysieve.sources import standard


def test_product_names_box_and_humidity(spark):
    rows = [(20.0, 75.0, 300.0, 300.0, 1.5), (60.0, 75.0, 300.0, 290.0, 2.5), (None, 75.0, 300.0, 290.0, 2.5)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, t2m double, d2m double, u10 double")
    got = standard.standardise(df, "era5").collect()
    assert len(got) == 1 and got[0].wind_u == 1.5 and math.isclose(got[0].rh, 100.0) and "d2m" not in got[0].asDict()
    two = standard.renamed(spark.createDataFrame([(None, 3.0), (1.0, 3.0)], "HPBL double, blh double"), "imdaa").collect()
    assert [r.blh for r in two] == [3.0, 1.0]
    assert math.isclose(standard.standardise(spark.createDataFrame([(1e-9, 2.0)], "OCSMASS double, TOTEXTTAU double"), "merra2").first().pm25, 1.6)
    with pytest.raises(ValueError):
        standard.renamed(df, "other")


def test_days_add_up_what_accumulates(spark):
    rows = [(dt.datetime(2024, 1, 1, h), 1.0, 2.0, float(h), 1.0 if h else float("nan")) for h in range(4)]
    got = standard.daily(spark.createDataFrame(rows, "time timestamp, lat double, lon double, t2m double, precip double")).first()
    assert got.day == dt.date(2024, 1, 1) and got.t2m == 1.5 and got.precip == 3.0


def test_quality_masks(spark):
    px = spark.createDataFrame([(0.8, 1.0), (0.7, 2.0), (None, 3.0)], "qa_value double, v double")
    assert [r.v for r in standard.mask_quality(px, "no2", value="v").collect()] == [1.0, None, None]
    assert [r.v for r in standard.mask_quality(px, "hcho", value="v").collect()] == [1.0, 2.0, None]
    dn = spark.createDataFrame([(0x00FF, 500), (0x0100, 500), (None, 500)], "AOD_QA int, aod_055 int")
    assert [r.aod for r in standard.scaled_depth(dn).collect()] == [0.5, None, None]


def test_points_in_polygons(spark, tmp_path):
    square = lambda a, b, n: [[a, b], [a + n, b], [a + n, b + n], [a, b + n], [a, b]]
    shapes = [("ring", {"type": "Polygon", "coordinates": [square(0, 0, 10), square(4, 4, 2)]}), ("two", {"type": "MultiPolygon", "coordinates": [[square(20, 0, 1)], [square(9, 9, 3)]]})]
    where = tmp_path / "regions.geojson"
    where.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in shapes]}, indent=1))
    polygons = regions.read_polygons(spark, str(where))
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.5, 9.5), (4, 0.5, 20.5), (5, 30.0, 30.0), (6, None, 1.0), (7, 9.9, 3.3)]
    points = spark.createDataFrame([(i, y, x, float(i)) for i, y, x in pts], "id int, lat double, lon double, v double")
    got = {(r.id, r.region) for r in regions.tagged(points, polygons).collect()}
    assert got == {(1, "ring"), (3, "ring"), (3, "two"), (4, "two"), (7, "ring")}
    assert sorted(r.id for r in regions.clip(points, polygons).collect()) == [1, 3, 4, 7]
    stats = {r.region: (r.n, r.mean, r.low, r.high) for r in regions.reduce_regions(points, polygons).collect()}
    assert stats == {"ring": (3, 11 / 3, 1.0, 7.0), "two": (2, 3.5, 3.0, 4.0)}
    assert regions.clip(points.limit(0), polygons).count() == 0 and regions.clip(points, polygons.limit(0)).count() == 0


def test_nearest_time(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", at(10), 1), ("a", at(16), 2), ("b", at(1), 3), ("c", at(1), 4), ("a", at(10), 1)], "s string, time timestamp, n int")
    series = spark.createDataFrame([("a", at(5), 50.0), ("a", at(15), 150.0), ("b", at(59), 9.0)], "s string, time timestamp, v double")
    got = sorted((r.n, r.v) for r in regions.nearest_time(rows, series, key=["s"]).collect() if r.n < 4)
    assert got == [(1, 50.0), (1, 50.0), (2, 150.0), (3, 9.0)]
    near = {r.n: r.v for r in regions.nearest_time(rows, series, key=["s"], within=600.0).collect()}
    assert near == {1: 50.0, 2: 150.0, 3: None, 4: None}

"""The index: golden values, edges, validity, categories."""

import math

import pytest
from pyspark.sql import functions as F

from skysieve.functions import aqi

# Fixed values: (pollutant, concentration, sub-index, tolerance).
GOLDEN = [
    ("pm25", 30.0, 50.0, 1e-9), ("pm25", 60.0, 100.0, 1e-9), ("pm25", 90.0, 200.0, 1e-9), ("pm25", 120.0, 300.0, 1e-9), ("pm25", 250.0, 400.0, 1e-9),
    ("pm25", 45.0, 75.5, 0.6), ("pm25", 125.0, 304.8, 0.6), ("co", 1.0, 50.0, 1e-9), ("co", 2.0, 100.0, 1e-9), ("co", 10.0, 200.0, 1e-9),
    ("o3", 168.0, 200.0, 1e-9), ("so2", 380.0, 200.0, 1e-9), ("nh3", 800.0, 200.0, 1e-9), ("pm25", 5000.0, 500.0, 1e-9),
]


def test_golden(spark):
    row = spark.range(1).select(*(aqi.sub_index(F.lit(c), p).alias(f"x{k}") for k, (p, c, _, _) in enumerate(GOLDEN))).first()
    for k, (_, _, want, tol) in enumerate(GOLDEN):
        assert abs(row[k] - want) <= tol, GOLDEN[k]


def test_missing_and_negative(spark):
    row = spark.range(1).select(*(aqi.sub_index(F.lit(v), "pm25").alias(n) for n, v in (("a", float("nan")), ("b", -1.0), ("c", float("inf"))))).first()
    assert list(row) == [None, None, None]
    with pytest.raises(KeyError):
        aqi.sub_index(F.lit(1.0), "xenon")


def test_table(spark):
    rows = [(90.0, 100.0, 40.0, 1.0), (250.0, 430.0, 180.0, 10.0), (30.0, 110.0, 40.0, 1.0), (90.0, None, 40.0, None), (None, None, 40.0, 1.0)]
    got = aqi.compute_aqi(spark.createDataFrame(rows, "pm25 double, pm10 double, no2 double, co double")).collect()
    assert [r.aqi_responsible for r in got] == ["pm25", "pm25", "pm10", None, None]
    assert [r.aqi_category for r in got] == ["Moderate", "Very Poor", "Moderate", None, None]
    assert got[0].aqi == 200 and got[1].aqi == 400 and math.isclose(got[2].aqi, 107, abs_tol=1)


def test_no_pollutant(spark):
    with pytest.raises(ValueError):
        aqi.compute_aqi(spark.range(1))


def test_colors(spark):
    row = spark.range(1).select(aqi.category_color(F.lit(50.0)).alias("a"), aqi.rgba(F.lit(None).cast("double")).alias("b"), aqi.category_index(F.lit(50.1)).alias("c")).first()
    assert row.a == "#009865" and row.b == [0.0, 0.0, 0.0, 0.0] and row.c == 1

"""Deterministic generators, all JVM-side: every number is a digest of its key, so any partitioning gives the same tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.constants import BOXES, INDIA_BOX


def draw(seed: int, name: str, *keys: Column) -> Column:
    """Uniform in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def normal(seed: int, name: str, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(draw(seed, f"{name}.a", *keys))) * F.cos(2 * math.pi * draw(seed, f"{name}.b", *keys))


def grid(spark: SparkSession, start: str, days: int, *, step: float = 1.0, box: tuple[float, float, float, float] = INDIA_BOX, seed: int = 42, cloud: float = 0.4) -> DataFrame:
    """(day, i, j, lat, lon, 12 variables): smooth fields with noise; six columns lose a share of cells to cloud."""
    n_lat, n_lon = (int(round((box[k + 2] - box[k]) / step)) + 1 for k in (1, 0))
    cells = spark.range(days * n_lat * n_lon).select(
        F.date_add(F.lit(start).cast("date"), F.floor(F.col("id") / (n_lat * n_lon)).cast("int")).alias("day"),
        F.floor(F.col("id") / n_lon).cast("long").alias("r"), (F.col("id") % n_lon).cast("int").alias("j"),
    ).withColumn("i", (F.col("r") % n_lat).cast("int")).drop("r")
    cells = cells.withColumns({"lat": box[1] + F.col("i") * step, "lon": box[0] + F.col("j") * step})
    a, b, c, d = BOXES["igp"]
    plain = F.exp(-(F.pow((F.col("lat") - (b + d) / 2) / 6, 2) + F.pow((F.col("lon") - (a + c) / 2) / 9, 2)))
    turn = 2 * math.pi * F.dayofyear("day") / 365.25
    z = lambda name: normal(seed, name, F.col("day"), F.col("i"), F.col("j"))
    fields = {
        "aod": F.abs(0.3 + 0.6 * plain + 0.1 * F.cos(turn) + 0.05 * z("aod")), "no2_col": F.abs(2e-5 + 8e-5 * plain + 5e-6 * z("no2")), "so2_col": F.abs(1e-5 + 4e-5 * plain + 4e-6 * z("so2")),
        "co_col": F.abs(0.03 + 0.02 * plain + 0.002 * z("co")), "o3_col": 0.12 + 0.01 * F.sin(turn) + 0.002 * z("o3"), "hcho_col": F.abs(8e-5 + 1.2e-4 * plain + 8e-6 * z("hcho")),
        "blh": F.abs(800 + 300 * F.sin(turn) - 200 * plain + 60 * z("blh")), "rh": F.least(F.greatest(55 + 15 * F.cos(turn) + 8 * z("rh"), F.lit(5.0)), F.lit(99.0)),
        "wind_u": 2 + F.sin(turn) + z("u"), "wind_v": -1 + F.cos(turn) + z("v"), "t2m": 298 - 0.4 * (F.col("lat") - 20) + 5 * F.sin(turn) + z("t"), "ssrd": F.abs(1.8e7 + 3e6 * F.sin(turn) + 5e5 * z("s")),
    }
    seen = draw(seed, "cloud", F.col("day"), F.floor(F.col("i") / 3), F.floor(F.col("j") / 3)) >= cloud
    hidden = ("aod", "no2_col", "so2_col", "co_col", "o3_col", "hcho_col")
    return cells.select("day", "i", "j", "lat", "lon", *(F.when(seen, v).alias(k) if k in hidden else v.alias(k) for k, v in fields.items()))


def fires(spark: SparkSession, start: str, days: int, *, n: int = 750, seed: int = 42, season: str = "oct_nov") -> DataFrame:
    """(fire_id, date, lat, lon, frp, sensor): four fifths in the crop belt, the rest in the forest belt."""
    if season not in ("oct_nov", "apr_may"):
        raise ValueError(f"unknown season {season!r}")
    k = F.col("id")
    crop = draw(seed, "where", k) < 0.8
    boxes = [BOXES["punjab_haryana"], BOXES["forest_belt"]]
    at = lambda axis, name: F.when(crop, boxes[0][axis] + draw(seed, name, k) * (boxes[0][axis + 2] - boxes[0][axis])).otherwise(boxes[1][axis] + draw(seed, name, k) * (boxes[1][axis + 2] - boxes[1][axis]))
    day = F.least(F.greatest(F.floor(days * (0.5 + 0.18 * normal(seed, "day", k))), F.lit(0)), F.lit(days - 1)).cast("int")
    sensor = F.when(draw(seed, "sensor", k) < 0.7, "VIIRS-SNPP").otherwise("MODIS")
    return spark.range(n).select(F.col("id").alias("fire_id"), F.date_add(F.lit(start).cast("date"), day).alias("date"), at(1, "lat").alias("lat"), at(0, "lon").alias("lon"), (-F.log(draw(seed, "frp", k)) * 20).alias("frp"), sensor.alias("sensor"))


def inject_fires(cube: DataFrame, burnt: DataFrame, *, step: float, box: tuple[float, float, float, float] = INDIA_BOX, strength: float = 2e-7, decay: float = 0.6, radius: int = 1) -> DataFrame:
    """Adds fire power, spread over neighbouring cells, to HCHO on the day and, decayed, on the next."""
    frp = burnt.groupBy(F.col("date").alias("day"), F.round((F.col("lat") - box[1]) / step).cast("int").alias("i"), F.round((F.col("lon") - box[0]) / step).cast("int").alias("j")).agg(F.sum("frp").alias("frp"))
    reach = [(a, b, math.exp(-(a * a + b * b) / 2)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t"), F.lit(w * d).alias("w")) for a, b, w in reach for t, d in ((0, 1.0), (1, decay)))))
    plume = frp.withColumn("s", spread).groupBy(F.date_add("day", F.col("s.t")).alias("day"), (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).agg(F.sum(F.col("frp") * F.col("s.w")).alias("plume"))
    return cube.join(plume, ["day", "i", "j"], "left").withColumn("hcho_col", F.col("hcho_col") + strength * F.coalesce("plume", F.lit(0.0))).drop("plume")


def stations(spark: SparkSession, cube: DataFrame, n: int = 120, *, step: float = 1.0, box: tuple[float, float, float, float] = INDIA_BOX, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(registry, labels): station places with their node, and daily labels that follow known laws of the node's variables."""
    k = F.col("id")
    reg = spark.range(n).select(F.col("id").alias("station"), (box[1] + draw(seed, "lat", k) * (box[3] - box[1])).alias("lat"), (box[0] + draw(seed, "lon", k) * (box[2] - box[0])).alias("lon"))
    n_lat, n_lon = (int(round((box[m + 2] - box[m]) / step)) for m in (1, 0))
    reg = reg.withColumns({"i": F.least(F.round((F.col("lat") - box[1]) / step), F.lit(n_lat)).cast("int"), "j": F.least(F.round((F.col("lon") - box[0]) / step), F.lit(n_lon)).cast("int")})
    at = reg.join(cube.drop("lat", "lon"), ["i", "j"])
    z = lambda name: normal(seed, name, F.col("station"), F.col("day"))
    lack = lambda name, v: F.when(draw(seed, f"lack.{name}", F.col("station"), F.col("day")) >= 0.05, v)
    aod = F.coalesce("aod", F.lit(0.5))
    pm25 = F.greatest(40 * aod * 800 / F.greatest(F.col("blh"), F.lit(50.0)) * (1 + F.col("rh") / 200) + 3 * z("pm25"), F.lit(1.0))
    rows = at.select("station", "day", pm25.alias("pm25"), z("pm10").alias("zz"), "no2_col", "so2_col", "co_col", "o3_col", "t2m")
    return reg, rows.select(
        "station", "day", "pm25", F.greatest(F.col("pm25") * 1.7 + 5 * F.col("zz"), F.lit(1.0)).alias("pm10"),
        F.abs(F.coalesce("no2_col", F.lit(4e-5)) * 5e5 + 2 * z("no2")).alias("no2"), lack("so2", F.abs(F.coalesce("so2_col", F.lit(2e-5)) * 4e5 + z("so2"))).alias("so2"),
        F.abs(F.coalesce("co_col", F.lit(0.04)) * 30 + 0.1 * z("co")).alias("co"), lack("o3", F.abs((F.col("t2m") - 273) * 2 + 4 * z("o3"))).alias("o3"),
    )

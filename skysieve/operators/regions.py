"""Points in polygons: clipping, tagging and statistics by region.

Polygons are rows (region, part, ring), a ring being an array of (lon, lat)
points; a region's parts add up, and a ring inside another is a hole (even-odd
rule). Points and rings meet by square buckets over the rings' boxes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysieve.functions.aqi import clean

RINGS = "region string, part int, ring array<struct<x: double, y: double>>"


def read_polygons(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """Rings of a GeoJSON file of polygons and multipolygons; a feature without the property is named by its place."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # boundaries, not data
    told, rows = json.loads(text), []
    for k, feature in enumerate(told["features"] if told.get("type") == "FeatureCollection" else [told]):
        shape = feature.get("geometry") or feature
        region = str((feature.get("properties") or {}).get(name, k))
        parts = {"Polygon": [shape["coordinates"]], "MultiPolygon": shape["coordinates"]}.get(shape["type"])
        if parts is None:
            raise ValueError(f"{shape['type']} is no polygon")
        rings = [ring for part in parts for ring in part]
        rows += [(region, n, [(float(p[0]), float(p[1])) for p in ring]) for n, ring in enumerate(rings)]
    return spark.createDataFrame(rows, RINGS)


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many edges of the ring a ray to the east of (x, y) crosses; an edge holds its lower end."""
    edge = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]))
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.size(F.filter(F.zip_with(ring, following, edge), lambda crossed: F.coalesce(crossed, F.lit(False))))


def tagged(points: DataFrame, polygons: DataFrame, *, id_col: str = "id", lat: str = "lat", lon: str = "lon", bucket: float = 1.0) -> DataFrame:
    """(id, region) for each region that a point is in. Points without a place are in none; ids should be unique."""
    end = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    cells = lambda c: F.sequence(F.floor(end(F.array_min, c) / bucket), F.floor(end(F.array_max, c) / bucket))
    spread = polygons.select("region", "part", "ring", F.explode(cells("x")).alias("bx"), cells("y").alias("by")).withColumn("by", F.explode("by"))
    at = points.select(F.col(id_col).alias("id"), clean(F.col(lon)).alias("x"), clean(F.col(lat)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    met = at.withColumns({"bx": F.floor(F.col("x") / bucket), "by": F.floor(F.col("y") / bucket)}).join(spread, ["bx", "by"])
    inside = met.groupBy("id", "region").agg(F.sum(crossings(F.col("ring"), F.col("x"), F.col("y"))).alias("n")).filter("n % 2 = 1")
    return inside.select(F.col("id").alias(id_col), "region")


def clip(points: DataFrame, polygons: DataFrame, *, id_col: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points in any of the polygons."""
    return points.join(tagged(points, polygons, id_col=id_col, lat=lat, lon=lon).select(id_col).distinct(), id_col, "left_semi")


def reduce_regions(points: DataFrame, polygons: DataFrame, *, value: str = "v", by: list[str] | None = None, id_col: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(region, by, n, mean, low, high) of the points' values in each region; regions without values are left out."""
    v = clean(F.col(value))
    rows = points.join(tagged(points.select(id_col, lat, lon).distinct(), polygons, id_col=id_col, lat=lat, lon=lon), id_col).filter(v.isNotNull())
    return rows.groupBy("region", *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def nearest_time(rows: DataFrame, series: DataFrame, *, key: list[str], time: str = "time", value: str = "v", within: float | None = None) -> DataFrame:
    """Adds the value of the key's nearest time (the earlier of two as near; null beyond ``within`` seconds). One sort by key and time; no range join."""
    stamp = F.col(time).cast("timestamp").cast("double")
    asked = rows.select(*key, stamp.alias("_t"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(series.schema[value].dataType).alias("_v"))
    known = series.select(*key, stamp.alias("_t"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*key).orderBy("_t")
    there = F.when(F.col("_row").isNull(), F.struct("_t", "_v"))
    both = asked.unionByName(known).withColumns({"_a": F.last(there, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_b": F.first(there, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    before, behind = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    pick = F.when(F.col("_b").isNull() | (before <= behind), F.col("_a")).otherwise(F.col("_b"))
    out = both.filter("_row IS NOT NULL").withColumn("_p", pick)
    near = F.col("_p._v") if within is None else F.when(F.abs(F.col("_p._t") - F.col("_t")) <= within, F.col("_p._v"))
    return out.select("_row.*", near.alias(value))

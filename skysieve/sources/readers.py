"""Readers and writers. Every reader takes an explicit schema or column list; nothing is inferred over large inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.constants import INDIA_BOX
from skysieve.functions.aqi import clean
from skysieve.functions.physics import aod_550, cell_id, in_box
from skysieve.operators.stations import normalise_records

# Sensor labels of the fire network's product names, and its column names.
SENSORS = {"VIIRS_SNPP_NRT": "VIIRS-SNPP", "VIIRS_NOAA20_NRT": "VIIRS-NOAA20", "VIIRS_NOAA21_NRT": "VIIRS-NOAA21", "MODIS_NRT": "MODIS"}
FIRE_COLUMNS = "latitude STRING, longitude STRING, bright_ti4 STRING, scan STRING, track STRING, acq_date STRING, acq_time STRING, satellite STRING, instrument STRING, confidence STRING, version STRING, bright_ti5 STRING, frp STRING, daynight STRING"


def read_parquet(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None, time: str = "time", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A table with a half-open time filter and an inclusive box filter, both pushed to the scan."""
    out = spark.read.parquet(path)
    if start:
        out = out.filter(F.col(time) >= F.lit(start).cast(out.schema[time].dataType))
    if end:
        out = out.filter(F.col(time) < F.lit(end).cast(out.schema[time].dataType))
    return out.filter(in_box(F.col("lat"), F.col("lon"), box)) if box else out


def read_fires(spark: SparkSession, path: str, source: str = "VIIRS_SNPP_NRT", *, box: tuple[float, float, float, float] = INDIA_BOX) -> DataFrame:
    """Fire CSV to (date, lat, lon, frp, sensor, cell); rows without place or date drop, bad numbers are null; a broken file fails the read."""
    raw = spark.read.schema(FIRE_COLUMNS).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return standardise_fires(raw, source, box=box)


def standardise_fires(raw: DataFrame, source: str, *, box: tuple[float, float, float, float] = INDIA_BOX) -> DataFrame:
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    out = raw.select(F.expr("try_cast(acq_date AS DATE)").alias("date"), number("latitude").alias("lat"), number("longitude").alias("lon"), number("frp").alias("frp"), F.lit(SENSORS.get(source, source)).alias("sensor"))
    out = out.na.drop(subset=["date", "lat", "lon"]).filter(in_box(F.col("lat"), F.col("lon"), box))
    return out.withColumn("cell", cell_id(F.col("lat"), F.col("lon")))


def read_station_json(spark: SparkSession, path: str, *, box: tuple[float, float, float, float] = INDIA_BOX) -> DataFrame:
    """Station network pages ({"records": [...]}) to long observations."""
    fields = "station STRING, city STRING, state STRING, pollutant_id STRING, avg_value STRING, last_update STRING, latitude STRING, longitude STRING"
    pages = spark.read.schema(f"records ARRAY<STRUCT<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>").option("multiLine", True).json(path)
    raw = pages.select(F.explode("records").alias("r")).select("r.*")
    aliases = {"station": "station", "city": "city", "state": "state", "pollutant_id": "pollutant", "avg_value": "value", "last_update": "ts", "latitude": "lat", "longitude": "lon"}
    pollutants = {"pm2.5": "pm25", "pm25": "pm25", "pm10": "pm10", "no2": "no2", "so2": "so2", "co": "co", "ozone": "o3", "o3": "o3", "nh3": "nh3", "pb": "pb"}
    return normalise_records(raw, aliases, pollutants, box)


def read_sun_photometer(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(site, day, aod_550): text with a preamble before its header; the header gives the columns, days are dd:mm:yyyy."""
    lines = spark.read.text(path).filter("value LIKE '%,%'")
    header = lines.filter(F.col("value").contains("Date(dd:mm:yyyy)")).select("value").first()
    if header is None:
        return spark.createDataFrame([], "site string, day date, aod_550 double")
    names = header[0].split(",")
    cells = F.split("value", ",")
    at = lambda n: F.expr(f"try_cast(get(split(value, ','), {names.index(n)}) AS DOUBLE)")
    day = F.to_date(F.try_to_timestamp(F.get(cells, F.lit(names.index("Date(dd:mm:yyyy)"))), F.lit("dd:MM:yyyy")))
    positive = lambda c: F.when(c > 0, c)
    rows = lines.select(day.alias("day"), aod_550(positive(at("AOD_440nm")), positive(at("AOD_675nm"))).alias("aod_550")).na.drop()
    return rows.groupBy("day").agg(F.avg("aod_550").alias("aod_550")).select(F.lit(site).alias("site"), "day", "aod_550")


def read_trajectory_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, trajectory, step, time, lat, lon, level) of trajectory dumps: white-space text whose data rows have 13 numbers; two-digit years turn at 50."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), parts.alias("p")).filter((F.size("p") >= 12) & F.col("p")[0].rlike(r"^\d+$"))
    n = lambda k: F.expr(f"try_cast(p[{k}] AS DOUBLE)")
    year = F.when(n(2) >= 50, n(2) + 1900).otherwise(n(2) + 2000).cast("int")
    time = F.make_timestamp(year, n(3).cast("int"), n(4).cast("int"), n(5).cast("int"), n(6).cast("int"), F.lit(0))
    return rows.select("file", n(0).cast("int").alias("trajectory"), F.abs(n(8)).alias("step"), time.alias("time"), n(9).alias("lat"), n(10).alias("lon"), n(11).alias("level")).na.drop(subset=["lat", "lon"])


def scale_aod(pixels: DataFrame, *, best_only: bool = True) -> DataFrame:
    """Stored numbers to optical depth (x 0.001); best quality keeps rows whose quality bits 8 to 11 are 0."""
    kept = pixels.filter(F.shiftright("qa", 8).bitwiseAND(15) == 0) if best_only else pixels
    return kept.withColumn("v", clean(F.col("v")) * 0.001)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows by column name, with a source column; what a source lacks is null."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] | None = None, sort_by: str | None = None) -> None:
    """Snappy Parquet; sorting is inside files, which keeps row-group statistics tight without a global order."""
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    writer = out.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_geo_lines(df: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features of points, a file a task."""
    props = [c for c in df.columns if c not in ("lat", "lon")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_geo_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    schema = f"type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties STRUCT<{properties}>"
    raw = spark.read.schema(schema).json(path)
    return raw.select(F.col("geometry.coordinates")[1].alias("lat"), F.col("geometry.coordinates")[0].alias("lon"), "properties.*")

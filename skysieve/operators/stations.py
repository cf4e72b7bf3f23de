"""Station tables: hourly to daily products, identities, duplicates, tags.

Observations are long rows (station, ts, pollutant, value). Daily products
shuffle once by (station, day); the hour spine is made inside that key, so the
window never sees more than one station-day of a pollutant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.constants import AVERAGING_HOURS, EARTH_KM
from skysieve.functions.aqi import clean
from skysieve.functions.physics import cell_id, in_box, region_of, station_id

PLANE_KM = 6371.0


def pivot_daily(obs: DataFrame, pollutants: tuple[str, ...], *, station: str = "station") -> DataFrame:
    """(station, day) rows with each pollutant's mean; the list is fixed, so no pass is spent on finding it."""
    avg = [F.avg(F.when(F.col("pollutant") == p, clean(F.col("value")))).alias(p) for p in pollutants]
    return obs.groupBy(station, F.to_date("ts").alias("day")).agg(*avg)


def completeness(obs: DataFrame, *, station: str = "station", least: float = 0.75) -> DataFrame:
    """(station, day, pollutant): rows with a value, their share of 24, and whether that is enough.

    Rows count, not hours, so sub-hourly data can exceed 1.
    """
    out = obs.filter(clean(F.col("value")).isNotNull()).groupBy(station, F.to_date("ts").alias("day"), "pollutant").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("completeness", F.col("n") / 24.0).withColumn("complete", F.col("n") / 24.0 >= least)


def rolling_max(obs: DataFrame, *, station: str = "station", hours: int = 8, least: float = 0.75) -> DataFrame:
    """(station, day, pollutant, rolling_max): the largest rolling mean over an hourly spine from the day's first to last hour.

    Hours are means of their rows; a window counts with three quarters of its
    hours present, and never crosses midnight.
    """
    key = [station, "day", "pollutant"]
    hourly = obs.filter(clean(F.col("value")).isNotNull()).groupBy(station, F.to_date("ts").alias("day"), "pollutant", F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    spine = hourly.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("at"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    steps = spine.select(*key, F.posexplode(F.transform(F.sequence("a", "b"), lambda h: F.col("at")[h])).alias("h", "v"))
    w = Window.partitionBy(*key).orderBy("h").rowsBetween(-(hours - 1), 0)
    rolled = steps.withColumn("m", F.when(F.count("v").over(w) >= int(least * hours), F.avg("v").over(w)))
    return rolled.groupBy(*key).agg(F.max("m").alias("rolling_max"))


def hourly_to_daily(obs: DataFrame, pollutants: tuple[str, ...], *, station: str = "station", least: float = 0.75) -> DataFrame:
    """(station, day) with each pollutant: the 8-hour rolling maximum for CO and ozone, else the mean; null below the completeness."""
    key = [station, "day", "pollutant"]
    enough = completeness(obs, station=station, least=least).filter("complete").select(*key)
    mean = obs.groupBy(station, F.to_date("ts").alias("day"), "pollutant").agg(F.avg(clean(F.col("value"))).alias("mean"))
    rolled = rolling_max(obs.filter(F.col("pollutant").isin(*AVERAGING_HOURS)), station=station)
    value = F.when(F.col("pollutant").isin(*AVERAGING_HOURS), F.col("rolling_max")).otherwise(F.col("mean"))
    daily = mean.join(enough.withColumn("ok", F.lit(True)), key, "left").join(rolled, key, "left")
    return daily.groupBy(station, "day").agg(*(F.max(F.when((F.col("pollutant") == p) & F.col("ok"), value)).alias(p) for p in pollutants))


def _plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Kilometres, each point projected with the cosine of its own latitude."""
    return F.radians(lon) * F.cos(F.radians(lat)) * PLANE_KM, F.radians(lat) * PLANE_KM


def near_pairs(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """(left_id, right_id, km) within the radius: points meet by square cells of the radius and their neighbours, not all with all."""
    x, y = _plane(F.col("lat"), F.col("lon"))
    at = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), x.alias(f"{p}_x"), y.alias(f"{p}_y"), F.floor(x / radius_km).alias("i"), F.floor(y / radius_km).alias("j"))
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    cells = F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in near))).alias("c")
    spread = at(right, "right").select("right_id", "right_x", "right_y", cells).select("right_id", "right_x", "right_y", "c.i", "c.j")
    km = F.sqrt(F.pow(F.col("left_x") - F.col("right_x"), 2) + F.pow(F.col("left_y") - F.col("right_y"), 2))
    return at(left, "left").join(spread, ["i", "j"]).withColumn("km", km).filter(F.col("km") <= radius_km).select("left_id", "right_id", "km")


def dedup_against(primary: DataFrame, second: DataFrame, *, radius_km: float = 1.0) -> DataFrame:
    """Both networks' rows, without second-network sites that stand within the radius of a primary one."""
    sites = lambda df: df.groupBy(F.col("station").alias("id")).agg(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon"))
    mirrors = near_pairs(sites(second), sites(primary), radius_km).select(F.col("left_id").alias("station")).distinct()
    return primary.unionByName(second.join(mirrors, "station", "left_anti"), allowMissingColumns=True)


def tag_stations(stations: DataFrame, *, validation_share: float = 0.18, seed: int = 42) -> DataFrame:
    """Adds tag: gapfill for sources that are no station network, else validation for a share of each region's stations, else label.

    The draw is by digest of the station id, so reruns agree.
    """
    draw = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("station").cast("string")).cast("binary"))
    sites = stations.select("station", "region").dropDuplicates(["station"])
    rank = F.row_number().over(Window.partitionBy("region").orderBy(draw, "station"))
    size = F.count(F.lit(1)).over(Window.partitionBy("region"))
    held = sites.withColumn("held", rank <= F.bround(size * validation_share)).select("station", "held")
    network = F.col("source").startswith("CPCB") | F.col("source").startswith("OpenAQ")
    tag = F.when(~F.coalesce(network, F.lit(False)), "gapfill").when(F.col("held"), "validation").otherwise("label")
    return stations.join(held, "station", "left").withColumn("tag", tag).drop("held")


def finalise_station_table(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open time filter, then id, cell and region."""
    kept = daily.filter((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    lat, lon = F.col("lat"), F.col("lon")
    return kept.withColumns({"station_id": station_id(F.col("name"), lat, lon), "cell": cell_id(lat, lon), "region": region_of(lat, lon)})


def registry(stations: DataFrame, order: str = "day") -> DataFrame:
    """The first row of each station."""
    w = Window.partitionBy("station").orderBy(order, "lat", "lon")
    return stations.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def normalise_records(raw: DataFrame, aliases: dict[str, str], pollutants: dict[str, str], box: tuple[float, float, float, float]) -> DataFrame:
    """Raw network records to long observations: column aliases, day-first stamps, pollutant aliases, numbers or null, box filter."""
    cols = {a: b for a, b in aliases.items() if a in raw.columns}
    out = raw.select(*(F.col(a).alias(b) for a, b in cols.items()))
    name = F.lower(F.trim(F.col("pollutant")))
    canonical = F.coalesce(*(F.when(name == a, F.lit(b)) for a, b in pollutants.items()))
    stamp = F.coalesce(F.try_to_timestamp("ts", F.lit("dd-MM-yyyy HH:mm:ss")), F.try_to_timestamp("ts", F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp("ts"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    out = out.withColumns({"pollutant": canonical, "ts": stamp, "value": number("value"), "lat": number("lat"), "lon": number("lon")})
    return out.na.drop(subset=["pollutant", "ts", "lat", "lon"]).filter(in_box(F.col("lat"), F.col("lon"), box))


__all__ = ["EARTH_KM", "completeness", "dedup_against", "finalise_station_table", "hourly_to_daily", "near_pairs", "normalise_records", "pivot_daily", "registry", "rolling_max", "tag_stations"]

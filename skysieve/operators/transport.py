"""Back trajectories, source maps, polar statistics, path clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.constants import EARTH_M, INDIA_BOX
from skysieve.functions.aqi import clean
from skysieve.functions.physics import bearing, compass, wind_dir, wind_speed
from skysieve.operators.fires import box_cell
from skysieve.operators.ranks import quantiles
from skysieve.operators.scratch import keep

#: Time steps of the wind whose releases share a slice of it, and trajectories that a task moves at once.
SPAN, LOT = 24, 5_000


def bilinear(field: np.ndarray, lats: np.ndarray, lons: np.ndarray, lat: np.ndarray, lon: np.ndarray, k: np.ndarray | int = 0) -> np.ndarray:
    """Bilinear values of ``field[k]``, held inside the axes; with missing corners the mean of the others, 0 without any."""
    field = field if field.ndim == 3 else field[None]
    y = np.clip((np.asarray(lat) - lats[0]) / (lats[1] - lats[0]), 0.0, len(lats) - 1.0)
    x = np.clip((np.asarray(lon) - lons[0]) / (lons[1] - lons[0]), 0.0, len(lons) - 1.0)
    i, j = np.minimum(y.astype(int), len(lats) - 2), np.minimum(x.astype(int), len(lons) - 2)
    box = np.stack([field[k, i, j], field[k, i, j + 1], field[k, i + 1, j], field[k, i + 1, j + 1]])
    a, b = y - i, x - j
    share = np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
    good = np.isfinite(box)
    present = np.where(good, box, 0.0)
    return np.where(good.all(axis=0), (present * share).sum(axis=0), present.sum(axis=0) / np.maximum(good.sum(axis=0), 1))


def step(lat: np.ndarray, lon: np.ndarray, u: np.ndarray, v: np.ndarray, seconds: float) -> tuple[np.ndarray, np.ndarray]:
    """Moves points by the wind on a sphere."""
    return (
        np.clip(lat + np.degrees(v * seconds / EARTH_M), -90.0, 90.0),
        lon + np.degrees(u * seconds / (EARTH_M * np.maximum(np.cos(np.radians(lat)), 1e-6))),
    )


def back_trajectories(wind: DataFrame, releases: DataFrame, *, hours: int = 96, minutes: int = 60, levels: tuple[float, ...] = (500.0,)) -> DataFrame:
    """(traj_id, step, time, lat, lon, level): midpoint integration back in time.

    ``wind``: time, lat, lon, u, v on a regular grid. ``releases``: release_id,
    time, lat, lon. Level does not change the wind. Releases of ``SPAN`` time
    steps meet the slice of the wind that their paths can reach, in lots of
    ``LOT`` that are moved together; only the axes of the grid are gathered.
    Times beyond the wind's use its first or last step.
    """
    spark = wind.sparkSession
    known = wind.select(F.unix_timestamp("time").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), clean(F.col("u")).alias("u"), clean(F.col("v")).alias("v"))
    t, lats, lons = (np.array(sorted(r[0] for r in known.select(c).distinct().collect()), float) for c in ("t", "lat", "lon"))
    if not len(t):
        raise ValueError("no wind")
    if len(lats) < 2 or len(lons) < 2:
        raise ValueError("the wind needs two latitudes and two longitudes")
    each = releases.select("release_id", F.unix_timestamp("time").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    each = each.withColumn("traj_id", F.concat_ws("@", F.col("release_id").cast("string"), F.col("level").cast("string")))
    # A release's span: that of the wind's last step not after it.
    starts = spark.createDataFrame([(float(t[k]) if k else -math.inf, float(t[k + SPAN]) if k + SPAN < len(t) else math.inf, k // SPAN) for k in range(0, len(t), SPAN)], "since double, until double, span int")
    each = each.join(F.broadcast(starts), (F.col("t") >= F.col("since")) & (F.col("t") < F.col("until")))
    sizes = {r[0]: -(-r[1] // LOT) for r in each.groupBy("span").count().collect()}
    reached = []
    for span, lots in sizes.items():
        low = max(0, int(np.searchsorted(t, t[span * SPAN] - hours * 3600.0 - minutes * 60.0, side="right")) - 1)
        high = min(len(t) - 1, (span + 1) * SPAN)
        reached += [(int(t[k]), span, lots) for k in range(min(low, max(0, high - 1)), high + 1)]
    if not reached:
        return spark.createDataFrame([], "traj_id string, step int, lat double, lon double, level double, time timestamp")
    slices = spark.createDataFrame(reached, "t long, span int, lots int")
    known = known.join(slices, "t").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    lots = spark.createDataFrame(list(sizes.items()), "span int, lots int")
    each = each.join(F.broadcast(lots), "span").withColumn("lot", F.pmod(F.xxhash64("traj_id"), F.col("lots")).cast("int"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return pd.DataFrame({"traj_id": [], "step": [], "t": [], "lat": [], "lon": [], "level": []})
        times = np.sort(left["t"].unique()).astype(float)
        cube = np.full((2, len(times), len(lats), len(lons)), np.nan)
        at = tuple(np.searchsorted(a, left[c].to_numpy(float)) for a, c in ((times, "t"), (lats, "lat"), (lons, "lon")))
        cube[0][at], cube[1][at] = left["u"], left["v"]

        def wind_at(when: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
            k = np.clip(np.searchsorted(times, when, side="right") - 1, 0, max(0, len(times) - 2))
            if len(times) == 1:
                return [bilinear(field, lats, lons, lat, lon, k) for field in cube]
            w = np.clip((when - times[k]) / (times[k + 1] - times[k]), 0.0, 1.0)
            return [bilinear(field, lats, lons, lat, lon, k) * (1 - w) + bilinear(field, lats, lons, lat, lon, k + 1) * w for field in cube]

        when, lat, lon = (right[c].to_numpy(float) for c in ("t", "lat", "lon"))
        dt, path = minutes * 60.0, [(when, lat, lon)]
        for _ in range(hours * 60 // minutes):
            mid = step(lat, lon, *wind_at(when, lat, lon), -dt / 2)
            lat, lon = step(lat, lon, *wind_at(when - dt / 2, *mid), -dt)
            when = when - dt
            path.append((when, lat, lon))
        n = len(right)
        out = {"traj_id": np.tile(right["traj_id"].to_numpy(), len(path)), "step": np.repeat(np.arange(len(path)), n)}
        out |= {c: np.concatenate([p[k] for p in path]) for k, c in enumerate(("t", "lat", "lon"))}
        return pd.DataFrame(out | {"level": np.tile(right["level"].to_numpy(), len(path))})

    out = known.groupBy("span", "lot").cogroup(each.groupBy("span", "lot")).applyInPandas(run, "traj_id string, step int, t double, lat double, lon double, level double")
    return out.withColumn("time", F.timestamp_seconds("t")).drop("t")


def _weight(n: Column, top: Column) -> Column:
    share = n / top
    return F.when(share > 0.8, 1.0).when(share > 0.5, 0.7).when(share > 0.2, 0.42).when(share > 0, 0.15).otherwise(0.0)


def _weighed(cells: DataFrame, weighted: bool) -> DataFrame:
    if not weighted:
        return cells
    top = cells.agg(F.max("n").alias("_top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("value", F.col("value") * _weight(F.col("n"), F.col("_top"))).drop("_top")


def cwt(endpoints: DataFrame, *, box: tuple[float, float, float, float] = INDIA_BOX, step: float = 0.5, weighted: bool = True) -> DataFrame:
    """(i, j, lat, lon, value, n): the mean receptor value (column ``v``) of endpoints by cell, weighted down where few passed."""
    i, j, inside = box_cell(F.col("lat"), F.col("lon"), box, step)
    cells = endpoints.filter(inside & clean(F.col("v")).isNotNull()).groupBy(i.alias("i"), j.alias("j")).agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n"))
    return _weighed(cells, weighted).withColumns({"lat": box[1] + (F.col("i") + 0.5) * step, "lon": box[0] + (F.col("j") + 0.5) * step})


def pscf(endpoints: DataFrame, *, box: tuple[float, float, float, float] = INDIA_BOX, step: float = 0.5, threshold: float | None = None, quantile: float = 0.75, weighted: bool = True, receptors: DataFrame | None = None) -> DataFrame:
    """The same with the share of endpoints whose receptor value is above the threshold (default: a quantile of the receptors' values)."""
    cut = quantiles(receptors if receptors is not None else endpoints, "v", [quantile])[0] if threshold is None else float(threshold)
    flagged = endpoints.withColumn("v", (F.col("v") > F.lit(cut)).cast("double"))
    return cwt(flagged, box=box, step=step, weighted=weighted)


def peak_cell(source_map: DataFrame) -> DataFrame:
    """(lat, lon, value) of the largest value, the lowest cell on ties."""
    best = F.max_by(F.struct("lat", "lon", "value"), F.struct("value", -F.col("i"), -F.col("j"))).alias("x")
    return source_map.filter(clean(F.col("value")).isNotNull()).agg(best).select("x.*")


def _bins(x: Column, width: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(x / width), F.lit(0)), F.lit(n - 1))


def polar_bins(rows: DataFrame, *, n_dir: int = 16, n_speed: int = 6, speed_max: float | None = None, statistic: str = "mean") -> DataFrame:
    """(speed_bin, dir_bin, value, n) from u, v, conc; speeds beyond the last bin (default end: 99th percentile) fall into it."""
    if statistic not in ("mean", "median", "max"):
        raise ValueError(f"unknown statistic {statistic!r}")
    r = rows.select(wind_speed(F.col("u"), F.col("v")).alias("s"), wind_dir(F.col("u"), F.col("v")).alias("d"), clean(F.col("conc")).alias("c"))
    top = max(quantiles(r, "s", [0.99])[0] or 0.0, 1e-6) if speed_max is None else float(speed_max)
    r = r.na.drop()
    agg = {"mean": F.avg, "median": F.median, "max": F.max}[statistic]
    return r.groupBy(_bins(F.col("s"), F.lit(top) / n_speed, n_speed).alias("speed_bin"), _bins(F.col("d"), F.lit(360.0 / n_dir), n_dir).alias("dir_bin")).agg(agg("c").alias("value"), F.count(F.lit(1)).alias("n"))


def dominant_direction(polar: DataFrame, n_dir: int = 16) -> DataFrame:
    """(dir_bin, value, n, bearing, compass) of the direction with the largest count-weighted mean."""
    by = polar.groupBy("dir_bin").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    top = by.agg(F.max_by(F.struct("dir_bin", "value", "n"), F.struct("value", -F.col("dir_bin"))).alias("x")).select("x.*")
    mid = (F.col("dir_bin") + 0.5) * (360.0 / n_dir)
    return top.withColumn("bearing", mid).withColumn("compass", compass(mid))


def pollution_rose(rows: DataFrame, *, n_dir: int = 16) -> DataFrame:
    """(dir_bin, quartile, n) from u, v, conc; a quartile's lower edge is inside it."""
    r = rows.select(wind_dir(F.col("u"), F.col("v")).alias("d"), clean(F.col("conc")).alias("c")).na.drop()
    quartile = sum(((F.col("c") >= F.lit(q)).cast("int") for q in quantiles(r, "c", [0.25, 0.5, 0.75])), F.lit(0))
    return r.groupBy(_bins(F.col("d"), F.lit(360.0 / n_dir), n_dir).alias("dir_bin"), quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


def resample_paths(trajectories: DataFrame, n: int = 24) -> DataFrame:
    """(traj_id, k, lat, lon): each path at n points, linear in step number; array functions only."""
    path = trajectories.groupBy("traj_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("p"))
    pos = F.col("k") * (F.size("p") - 1) / F.lit(float(max(1, n - 1)))
    at = path.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pos", pos).withColumn("a", F.floor("pos").cast("int"))
    p0, p1, w = F.element_at("p", F.col("a") + 1), F.element_at("p", F.least(F.col("a") + 2, F.size("p"))), F.col("pos") - F.col("a")
    return at.select("traj_id", "k", *((p0[c] * (1 - w) + p1[c] * w).alias(c) for c in ("lat", "lon")))


def _chord(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Central angle in radians."""
    a, b, d = F.radians(lat0), F.radians(lat1), F.radians(lon1 - lon0)
    return F.acos(F.least(F.greatest(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d), F.lit(-1.0)), F.lit(1.0)))


def angle_distances(paths: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """(a, b, distance) of pairs a < b of resampled paths: the mean angle at the origin between points of the same place in line."""
    lat, lon = F.lit(origin[0]), F.lit(origin[1])
    side = lambda p: paths.select(F.col("traj_id").alias(p), "k", F.col("lat").alias(f"{p}y"), F.col("lon").alias(f"{p}x"), _chord(lat, lon, F.col("lat"), F.col("lon")).alias(f"{p}r"))
    rows = side("a").join(side("b"), "k").filter("a < b")
    opposite = _chord(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))
    cosine = F.try_divide(F.cos(opposite) - F.cos("ar") * F.cos("br"), F.sin("ar") * F.sin("br"))
    return rows.groupBy("a", "b").agg(F.avg(F.acos(F.least(F.greatest(F.coalesce(cosine, F.lit(1.0)), F.lit(-1.0)), F.lit(1.0)))).alias("distance"))


def cluster_paths(trajectories: DataFrame, n_clusters: int = 3, origin: tuple[float, float] = (20.0, 78.0), *, n_points: int = 24, seed: int = 42, rounds: int = 100) -> DataFrame:
    """(traj_id, cluster, medoid): k-medoids on angle distances. Distances stay in Spark; only the k medoids are on the driver."""
    paths = keep(resample_paths(trajectories, n_points), "paths")
    half = angle_distances(paths, origin)
    own = paths.select(F.col("traj_id").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))
    dist = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(own)
    dist = keep(dist, "distances")
    ids = own.select("a")
    medoids = [r[0] for r in ids.orderBy(F.xxhash64(F.col("a"), F.lit(seed)), "a").limit(n_clusters).collect()]
    if not medoids:
        raise ValueError("no trajectory")
    for _ in range(rounds):
        near = dist.filter(F.col("b").isin(medoids)).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("medoid"))
        cost = dist.join(near, "a").join(near.select(F.col("a").alias("b"), F.col("medoid").alias("of")), "b").filter("medoid = of").groupBy("of", "b").agg(F.sum("distance").alias("cost"))
        better = sorted(r[0] for r in cost.groupBy("of").agg(F.min_by("b", F.struct("cost", "b")).alias("m")).select("m").collect())
        if better == sorted(medoids):
            break
        medoids = better
    order = {m: k for k, m in enumerate(sorted(medoids))}
    return near.select(F.col("a").alias("traj_id"), F.coalesce(*(F.when(F.col("medoid") == m, F.lit(k)) for m, k in order.items())).alias("cluster"), "medoid")


def pathways(clusters: DataFrame, paths: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """(cluster, size, share, bearing, compass) by the end of each cluster's mean path, largest first by ``rank``."""
    last = paths.groupBy("traj_id").agg(F.max_by("lat", "k").alias("lat"), F.max_by("lon", "k").alias("lon"))
    out = clusters.join(last, "traj_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    b = bearing(F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lon"))
    w = Window.partitionBy(F.lit(0))  # a row a cluster
    return out.select("cluster", "size", (F.col("size") / F.sum("size").over(w)).alias("share"), b.alias("bearing"), compass(b).alias("compass"), F.row_number().over(w.orderBy(F.desc("size"), "cluster")).alias("rank"))

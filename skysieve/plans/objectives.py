"""The two end-to-end products, as plans over tables.

1. Daily surface index: grid, stations and fires become a feature matrix; a
   model a pollutant is cross-validated and fitted; the whole cube is predicted
   and turned into the index.
2. Hotspots and transport: the HCHO cube's climatology, voted hotspots with
   their polygons and history, and fire series with lagged correlation and
   emissions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.functions.aqi import compute_aqi_grid
from skysieve.functions.physics import in_box
from skysieve.operators import features, fires, grids, metrics, models, spatial
from skysieve.operators.scratch import keep

POLLUTANTS = ("pm25", "pm10", "no2")


@dataclass
class SurfaceIndex:
    matrix: DataFrame
    scores: DataFrame
    grid: DataFrame


@dataclass
class Hotspots:
    climatology: DataFrame
    votes: DataFrame
    polygons: DataFrame
    history: DataFrame
    correlation: DataFrame
    inventory: DataFrame


def surface_index(cube: DataFrame, stations: DataFrame, labels: DataFrame, burnt: DataFrame | None = None, *, pollutants: tuple[str, ...] = POLLUTANTS, kind: str = "forest", scheme: str = "leave_station_out", n_folds: int = 3, **more) -> SurfaceIndex:  # noqa: ANN003
    """Lagged labels are no predictors here, as the cube has none."""
    matrix = keep(features.build_feature_matrix(cube, stations, labels, burnt, lagged=()), "matrix").withColumn("id", F.xxhash64("station", "day"))
    columns = [c for c in features.feature_columns(matrix) if c not in ("id", "fire_count", "fire_frp_sum")]
    predicted, scores = features.build_grid_features(cube), None
    for p in pollutants:
        rows = matrix.filter(F.col(p).isNotNull())
        oof = models.cross_validate(rows, columns, p, models.folds(scheme, rows, n=n_folds), kind="linear")
        table = metrics.metrics_table(oof, y=p, p="prediction").withColumn("pollutant", F.lit(p))
        scores = table if scores is None else scores.unionByName(table)
        predicted = models.predict(models.fit(rows, columns, p, kind, **more), predicted, columns, as_name=f"{p}_pred")
    index = compute_aqi_grid(predicted, column_map={p: f"{p}_pred" for p in pollutants})
    return SurfaceIndex(matrix, scores, index.select("day", "i", "j", "lat", "lon", *(f"{p}_pred" for p in pollutants), "aqi", "aqi_responsible", "aqi_category"))


def hotspots(cube: DataFrame, burnt: DataFrame, *, value: str = "hcho_col", reach: float, box: tuple[float, float, float, float] | None = None, alpha: float = 0.05, votes: int = 2, eps_km: float = 300.0, max_lag: int = 5) -> Hotspots:
    """``reach`` (degrees) must hold eight neighbours of a cell."""
    rows = keep(cube.select("i", "j", "lat", "lon", F.col("day").alias("t"), F.col(value).alias("v")), "cube")
    clim = grids.climatology(rows)
    field = rows.groupBy("i", "j", "lat", "lon").agg(F.avg("v").alias("v"))
    cells = keep(grids.spatial_anomaly(field).withColumn("id", F.col("i") * 10_000 + F.col("j")), "cells")
    weights = keep(spatial.knn_weights(cells, 8, reach=reach), "weights")
    voted = keep(spatial.consensus(cells, weights, gi_alpha=alpha, lisa_alpha=alpha, votes=votes), "votes")
    hot = cells.join(voted.select("id"), "id").withColumn("v", F.col("z_spatial"))
    polygons = spatial.hotspot_polygons(hot, spatial.dbscan(hot, eps_km=eps_km, least=3))
    bins = rows.filter("v IS NOT NULL").select((F.col("i") * 10_000 + F.col("j")).alias("id"), F.unix_date("t").alias("t"), "v")
    history = spatial.emerging_hotspots(bins.join(cells.select("id", "lat", "lon"), "id"), weights, gi_alpha=alpha)
    inside = rows if box is None else rows.filter(in_box(F.col("lat"), F.col("lon"), box))
    daily = fires.daily_series(burnt, box).join(inside.groupBy(F.col("t").alias("date")).agg(F.avg("v").alias("hcho")), "date")
    return Hotspots(clim, voted, polygons, history, fires.lagged_correlation(daily, "frp_sum", "hcho", max_lag=max_lag, window=5), fires.inventory_ensemble(burnt))

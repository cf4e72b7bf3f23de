"""Feature matrices: nearest grid node, fire counts, lags, rolling statistics, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.physics import add_physics_features, cell_id, day_of_year_features

LABELS = ("pm25", "pm10", "no2", "so2", "co", "o3")
KEYS = ("station", "station_id", "time", "day", "lat", "lon", "cell", "region", "name", "i", "j", "tag", "source")


def axis_index(value: Column, first: float, step: float, count: int) -> Column:
    """Nearest place on a regular axis, ties to the lower, held inside."""
    return F.least(F.greatest(F.ceil((value - first) / step - 0.5), F.lit(0)), F.lit(count - 1)).cast("int")


def nearest_node(points: DataFrame, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """Adds the node (i, j) of a regular grid by arithmetic; no distance is ever computed between rows."""
    return points.withColumns({"i": axis_index(F.col("lat"), lat0, step, n_lat), "j": axis_index(F.col("lon"), lon0, step, n_lon)})


def fire_counts(fires: DataFrame, *, resolution: int = 7) -> DataFrame:
    """(cell, day): fire_count and fire_frp_sum."""
    return fires.groupBy(cell_id(F.col("lat"), F.col("lon"), resolution).alias("cell"), F.to_date("date").alias("day")).agg(
        F.count(F.lit(1)).alias("fire_count"), F.sum("frp").alias("fire_frp_sum")
    )


def add_lags(df: DataFrame, columns: list[str], lags: list[int], *, group: str | None = None, time: str = "day") -> DataFrame:
    """{column}_lag{n}: the value n rows earlier in the group."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(time)
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in lags})


_STATS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp, "median": F.median}


def add_rolling(df: DataFrame, columns: list[str], windows: list[int], *, group: str | None = None, time: str = "day", stats: tuple[str, ...] = ("mean",), least: int = 1) -> DataFrame:
    """{column}_roll{w}_{stat} over the last w rows, where at least ``least`` of them have a value."""
    base = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(time)
    new = {}
    for c in columns:
        for n in windows:
            w = base.rowsBetween(-(n - 1), 0)
            for s in stats:
                if s not in _STATS:
                    raise ValueError(f"unknown statistic {s!r}")
                new[f"{c}_roll{n}_{s}"] = F.when(F.count(c).over(w) >= least, _STATS[s](c).over(w))
    return df.withColumns(new)


def sequences(df: DataFrame, columns: list[str], *, group: str = "station", time: str = "day", window: int = 7, stride: int = 1, target: str | None = None) -> DataFrame:
    """(group, end, values[, target]): arrays of ``window`` consecutive rows, every ``stride``-th; shorter groups give none."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be positive")
    order = Window.partitionBy(group).orderBy(time)
    rows = df.withColumn("rn", F.row_number().over(order)).withColumn("values", F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(order.rowsBetween(-(window - 1), 0)))
    kept = rows.filter((F.col("rn") >= window) & ((F.col("rn") - window) % stride == 0))
    return kept.select(group, F.col(time).alias("end"), "values", *([F.col(target).alias("target")] if target else []))


def long_samples(grid: DataFrame, nodes: DataFrame) -> DataFrame:
    """Grid rows at the stations' nodes, one a station and day: an equi-join on (i, j)."""
    return nodes.select("station", "i", "j").join(grid, ["i", "j"])


def build_feature_matrix(grid: DataFrame, stations: DataFrame, labels: DataFrame, fires: DataFrame | None = None, *, static: DataFrame | None = None, lags: tuple[int, ...] = (1, 3), lagged: tuple[str, ...] = ("aod", "no2_col", "pm25", "pm10")) -> DataFrame:
    """Station registry x grid samples, labels by (station, day), fires by (cell, day) with 0 where there are none, then lags.

    ``stations``: station, lat, lon, i, j. ``grid``: i, j, day and variables.
    """
    out = long_samples(grid.drop("lat", "lon"), stations).join(stations.select("station", "lat", "lon", cell_id(F.col("lat"), F.col("lon")).alias("cell")), "station")
    if static is not None:
        out = out.join(static, ["i", "j"], "left")
    out = add_physics_features(out)
    sin, cos = day_of_year_features(F.col("day"))
    out = out.withColumns({"doy_sin": sin, "doy_cos": cos}).join(labels, ["station", "day"], "left")
    if fires is not None:
        out = out.join(fire_counts(fires), ["cell", "day"], "left")
    for c in ("fire_count", "fire_frp_sum"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0))) if c in out.columns else out.withColumn(c, F.lit(0))
    there = [c for c in lagged if c in out.columns]
    return add_lags(out, there, list(lags), group="station") if there and lags else out


def build_grid_features(grid: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """The same predictors over the whole cube; static layers repeat over time."""
    out = grid.join(static, ["i", "j"], "left") if static is not None else grid
    sin, cos = day_of_year_features(F.col("day"))
    return add_physics_features(out).withColumns({"doy_sin": sin, "doy_cos": cos})


def feature_columns(matrix: DataFrame) -> list[str]:
    """Numeric columns that are no label and no key; lagged labels stay."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in matrix.dtypes if t in numeric and c not in LABELS and c not in KEYS]

"""Stages run from a configuration, on the command line or by ``run``.

    python -m skysieve.plans.runner hotspots --config stage.json

A configuration names the input tables, where results go, and options of the
stage, each optional where the operator has a default:

    {"inputs": {"cube": "/data/cube", "fires": "/data/fires"}, "output": "/data/out", "options": {"reach": 0.6}}

Inputs are Parquet folders, but for stages that read a product's own files. A
result is a table of the output folder. YAML files are read where its library
is installed.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.constants import BOXES, POLLUTANTS, SENSOR_RELIABILITY
from skysieve.functions.aqi import compute_aqi_grid
from skysieve.operators import features, fires, grids, metrics, models, regions, transport
from skysieve.operators.scratch import keep
from skysieve.plans import objectives
from skysieve.sources import readers, standard, synthetic

Tables = dict[str, DataFrame]
Stage = Callable[..., Tables]
STAGES: dict[str, Stage] = {}


def stage(f: Stage) -> Stage:
    STAGES[f.__name__] = f
    return f


def _table(spark: SparkSession, inputs: dict[str, str], name: str) -> DataFrame:
    if name not in inputs:
        raise ValueError(f"the configuration names no input {name!r}")
    return readers.read_parquet(spark, inputs[name])


@stage
def ingest_fires(spark: SparkSession, inputs: dict[str, str], *, source: str = "VIIRS_SNPP_NRT", box: str = "india") -> Tables:
    return {"fires": readers.read_fires(spark, inputs["fires"], source, box=BOXES[box])}


@stage
def ingest_stations(spark: SparkSession, inputs: dict[str, str], *, box: str = "india") -> Tables:
    return {"observations": readers.read_station_json(spark, inputs["stations"], box=BOXES[box])}


@stage
def ingest_product(spark: SparkSession, inputs: dict[str, str], *, product: str, box: str = "india", time: str = "time", daily: bool = True) -> Tables:
    """A product's table in common names and units, by day."""
    out = standard.standardise(_table(spark, inputs, "raw"), product, box=BOXES[box])
    return {product: standard.daily(out, time=time) if daily else out}


@stage
def fuse(spark: SparkSession, inputs: dict[str, str], *, weights: dict[str, float] | None = None, method: str = "auto") -> Tables:
    """Depths of several sensors (rows i, j, lat, lon, t, source, v) as one field, with its gaps filled."""
    stack = _table(spark, inputs, "stack")
    fused = grids.weighted_composite(stack, weights or SENSOR_RELIABILITY, by=["i", "j", "lat", "lon", "t"])
    fused = keep(fused.withColumnRenamed("fused", "v"), "fused")
    return {"fused": grids.fill_gaps(fused, method), "gaps": grids.gap_report(fused, ["v"])}


@stage
def build_features(spark: SparkSession, inputs: dict[str, str], *, lags: tuple[int, ...] = (1, 3)) -> Tables:
    burnt = _table(spark, inputs, "fires") if "fires" in inputs else None
    return {"matrix": features.build_feature_matrix(_table(spark, inputs, "cube"), _table(spark, inputs, "stations"), _table(spark, inputs, "labels"), burnt, lags=tuple(lags))}


@stage
def train(spark: SparkSession, inputs: dict[str, str], *, pollutants: tuple[str, ...] = objectives.POLLUTANTS, kind: str = "boosted", scheme: str = "leave_station_out", models_path: str | None = None, n: int = 3) -> Tables:
    """Pooled out-of-fold scores of a model a pollutant, which are saved under ``models_path``."""
    matrix = _table(spark, inputs, "matrix").withColumn("id", F.xxhash64("station", "day"))
    columns = [c for c in features.feature_columns(matrix) if c != "id"]
    scores = None
    for p in pollutants:
        rows = matrix.filter(F.col(p).isNotNull())
        oof = models.cross_validate(rows, columns, p, models.folds(scheme, rows, n=n), kind=kind)
        table = metrics.metrics_table(oof, y=p, p="prediction").withColumn("pollutant", F.lit(p))
        scores = table if scores is None else scores.unionByName(table)
        if models_path:
            models.save_model(models.fit(rows, columns, p, kind), f"{models_path}/{p}")
    return {"scores": scores}


@stage
def predict(spark: SparkSession, inputs: dict[str, str], *, models_path: str, pollutants: tuple[str, ...] = objectives.POLLUTANTS) -> Tables:
    """Saved models over the cube, and the index of their predictions."""
    grid = features.build_grid_features(_table(spark, inputs, "cube"))
    for p in pollutants:
        model = models.load_model(f"{models_path}/{p}")
        grid = models.predict(model, grid, list(model.stages[0].getInputCols()), as_name=f"{p}_pred")
    return {"index": compute_aqi_grid(grid, column_map={p: f"{p}_pred" for p in pollutants})}


@stage
def surface_index(spark: SparkSession, inputs: dict[str, str], **options) -> Tables:  # noqa: ANN003
    burnt = _table(spark, inputs, "fires") if "fires" in inputs else None
    out = objectives.surface_index(_table(spark, inputs, "cube"), _table(spark, inputs, "stations"), _table(spark, inputs, "labels"), burnt, **options)
    return {"matrix": out.matrix, "scores": out.scores, "grid": out.grid}


@stage
def hotspots(spark: SparkSession, inputs: dict[str, str], *, reach: float, **options) -> Tables:  # noqa: ANN003
    out = objectives.hotspots(_table(spark, inputs, "cube"), _table(spark, inputs, "fires"), reach=reach, **options)
    return {n: getattr(out, n) for n in ("climatology", "votes", "polygons", "history", "correlation", "inventory")}


@stage
def trajectories(spark: SparkSession, inputs: dict[str, str], *, hours: int = 96, clusters: int = 3, origin: tuple[float, float] = (20.0, 78.0)) -> Tables:
    """Back trajectories of the releases, with their clusters and main pathways."""
    paths = keep(transport.back_trajectories(_table(spark, inputs, "wind"), _table(spark, inputs, "releases"), hours=hours), "paths")
    grouped = keep(transport.cluster_paths(paths, clusters, tuple(origin)), "clusters")
    return {"paths": paths, "clusters": grouped, "pathways": transport.pathways(grouped, transport.resample_paths(paths), tuple(origin))}


@stage
def inventory(spark: SparkSession, inputs: dict[str, str], *, species: str = "hcho", biome: str = "crop_residue", step: float = 0.25) -> Tables:
    burnt = _table(spark, inputs, "fires")
    return {"grid": fires.grid_emissions(burnt, species, biome=biome, step=step), "ensemble": fires.inventory_ensemble(burnt, species, biome=biome)}


@stage
def episodes(spark: SparkSession, inputs: dict[str, str], *, period: int = 365, sigma: float = 1.5) -> Tables:
    return {"episodes": fires.episodes(_table(spark, inputs, "fires"), period=period, sigma=sigma)}


@stage
def validate(spark: SparkSession, inputs: dict[str, str], *, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None) -> Tables:
    """Agreement metrics, and the confusion of index bands."""
    pairs = _table(spark, inputs, "pairs")
    return {"metrics": metrics.metrics_table(pairs, by, y=y, p=p), "confusion": metrics.normalised_confusion(metrics.confusion(pairs, y=y, p=p), "true")}


@stage
def clip(spark: SparkSession, inputs: dict[str, str], *, id_col: str = "id", name: str = "name") -> Tables:
    """Points inside the polygons of a GeoJSON file."""
    return {"points": regions.clip(_table(spark, inputs, "points"), regions.read_polygons(spark, inputs["polygons"], name), id_col=id_col)}


@stage
def demo(spark: SparkSession, inputs: dict[str, str], *, days: int = 60, step: float = 0.25, n_stations: int = 120, n_fires: int = 750, start: str = "2023-10-01") -> Tables:
    """Both objectives over a generated world; no input."""
    burnt = keep(synthetic.fires(spark, start, days, n=n_fires), "fires")
    cube = keep(synthetic.inject_fires(synthetic.grid(spark, start, days, step=step), burnt, step=step), "cube")
    reg, labels = (keep(t, n) for t, n in zip(synthetic.stations(spark, cube, n=n_stations, step=step), ("stations", "labels"), strict=True))
    surface = objectives.surface_index(cube, reg, labels, burnt)
    hot = objectives.hotspots(cube, burnt, reach=2.5 * step)
    return {"scores": surface.scores, "grid": surface.grid, "votes": hot.votes, "polygons": hot.polygons, "history": hot.history, "inventory": hot.inventory}


def read_config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def run(spark: SparkSession, name: str, config: dict) -> Tables:
    """Runs a stage; its results are written where the configuration names an output."""
    if name not in STAGES:
        raise ValueError(f"unknown stage {name!r}; one of {sorted(STAGES)}")
    out = STAGES[name](spark, config.get("inputs") or {}, **(config.get("options") or {}))
    where = config.get("output")
    if where:
        for table, df in out.items():
            readers.write_parquet(df, f"{where}/{table}")
        out = {table: spark.read.parquet(f"{where}/{table}") for table in out}
    return out


def info() -> str:
    """The stages, with their first lines, and the pollutants of the index."""
    told = (f"{n}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else 'see its operator'}" for n, f in sorted(STAGES.items()))
    return "\n".join([*told, f"pollutants: {', '.join(POLLUTANTS)}"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run a stage, or `info`.")
    parser.add_argument("stage", choices=[*sorted(STAGES), "info"])
    parser.add_argument("--config", help="JSON or YAML file")
    args = parser.parse_args(argv)
    if args.stage == "info":
        print(info())
        return
    spark = SparkSession.builder.appName(f"skysieve-{args.stage}").getOrCreate()
    for name, df in run(spark, args.stage, read_config(args.config) if args.config else {}).items():
        print(name, df.count())


if __name__ == "__main__":
    main()

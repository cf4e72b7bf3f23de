"""Surface models, ensembles, and leakage-aware cross-validation on MLlib.

Splitters give rows (fold, id, role) with role train or test, so that a fold is
a filter and every split can be checked by SQL.
"""

from __future__ import annotations

import itertools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.aqi import clean
from skysieve.operators.metrics import conformal_quantile, metrics_table
from skysieve.operators.scratch import keep

KINDS = ("linear", "forest", "boosted")


def _stages(kind: str, columns: list[str], label: str, seed: int, **more) -> list:  # noqa: ANN003
    filled = [f"_f_{c}" for c in columns]
    out = [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x", handleInvalid="keep")]
    if kind == "linear":
        return [*out, StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LinearRegression(featuresCol="_z", labelCol=label, predictionCol="prediction", regParam=more.get("alpha", 1.0) / 100, elasticNetParam=0.0, solver="normal")]
    if kind == "forest":
        return [*out, RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="prediction", numTrees=more.get("trees", 40), maxDepth=more.get("depth", 8), minInstancesPerNode=3, seed=seed)]
    if kind == "boosted":
        return [*out, GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="prediction", maxIter=more.get("trees", 20), stepSize=more.get("rate", 0.1), maxDepth=more.get("depth", 5), seed=seed)]
    raise ValueError(f"unknown model {kind!r}; one of {KINDS}")


def fit(rows: DataFrame, columns: list[str], label: str, kind: str = "boosted", *, seed: int = 42, **more) -> PipelineModel:  # noqa: ANN003
    """Median imputing, assembling and a regressor, on rows with a label. Trained from sketches and sums over partitions, never on gathered rows."""
    known = rows.withColumns({c: clean(F.col(c)) for c in [*columns, label]}).filter(F.col(label).isNotNull())
    if len(known.head(2)) < 2:
        raise ValueError(f"fewer than two rows with {label}")
    return Pipeline(stages=_stages(kind, columns, label, seed, **more)).fit(known)


def predict(model: PipelineModel, rows: DataFrame, columns: list[str], *, as_name: str = "prediction") -> DataFrame:
    """Adds the prediction, 0 at least; predictors that the rows lack count as missing."""
    there = rows.withColumns({c: clean(F.col(c)) if c in rows.columns else F.lit(None).cast("double") for c in columns})
    out = model.transform(there)
    keep = [c for c in out.columns if not c.startswith(("_f_", "_x", "_z")) and c != "prediction"]
    return out.select(*keep, F.greatest(F.col("prediction"), F.lit(0.0)).alias(as_name))


def predict_many(models: dict[str, PipelineModel], rows: DataFrame, columns: list[str]) -> DataFrame:
    """A ``{pollutant}_pred`` column for each model."""
    for name, model in models.items():
        rows = predict(model, rows, columns, as_name=f"{name}_pred")
    return rows


def importances(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    last = model.stages[-1]
    raw = [abs(v) for v in (last.coefficients if hasattr(last, "coefficients") else last.featureImportances.toArray())]
    return {c: float(v / (sum(raw) or 1.0)) for c, v in zip(columns, raw, strict=True)}


def tree_quantiles(model: PipelineModel, rows: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles over the trees' own predictions, in order, 0 at least."""
    out = model.transform(rows.withColumns({c: clean(F.col(c)) for c in columns}))
    trees = []
    for k, tree in enumerate(model.stages[-1].trees):
        out = tree.setPredictionCol(f"_t{k}").transform(out)
        trees.append(F.col(f"_t{k}"))
    ordered = F.array_sort(F.array(*trees))

    def at(q: float) -> Column:
        pos = q * (len(trees) - 1)
        k = int(pos)
        return F.greatest(F.element_at(ordered, k + 1) * (1 - pos + k) + F.element_at(ordered, min(k + 2, len(trees))) * (pos - k), F.lit(0.0))

    keep = [c for c in rows.columns]
    return out.select(*keep, *(at(q).alias(f"q{round(q * 100):02d}") for q in quantiles))


def blend(rows: DataFrame, members: list[str], weights: list[float] | None = None, *, as_name: str = "blend") -> DataFrame:
    if not members:
        raise ValueError("no members")
    w = weights or [1.0] * len(members)
    total = sum(w)
    return rows.withColumn(as_name, F.greatest(sum((F.col(m) * (x / total) for m, x in zip(members, w, strict=True)), F.lit(0.0)), F.lit(0.0)))


def blend_weights(rows: DataFrame, members: list[str], label: str, *, step: float = 0.05) -> list[float]:
    """Weights on the simplex, in steps, with the least squared error.

    The error of every mixture follows from one aggregation of the members'
    products, so rows are read once however many mixtures are tried.
    """
    cols = [clean(F.col(m)) for m in members] + [clean(F.col(label))]
    ok = [c.isNotNull() for c in cols]
    good = ok[0]
    for c in ok[1:]:
        good = good & c
    n = len(cols)
    sums = rows.filter(good).agg(*(F.sum(cols[a] * cols[b]).alias(f"s{a}_{b}") for a in range(n) for b in range(a, n))).first()
    s = lambda a, b: sums[f"s{min(a, b)}_{max(a, b)}"] or 0.0
    parts, best, least = round(1 / step), [1.0 / len(members)] * len(members), float("inf")
    for cut in itertools.combinations(range(parts + len(members) - 1), len(members) - 1):
        edges = [-1, *cut, parts + len(members) - 1]
        w = [(edges[k + 1] - edges[k] - 1) / parts for k in range(len(members))]
        err = s(n - 1, n - 1) - 2 * sum(w[a] * s(a, n - 1) for a in range(n - 1)) + sum(w[a] * w[b] * s(a, b) for a in range(n - 1) for b in range(n - 1))
        if err < least:
            best, least = w, err
    return best


def conformal_intervals(calibration: DataFrame, rows: DataFrame, *, label: str, alpha: float = 0.1, prediction: str = "prediction") -> DataFrame:
    """Adds lower and upper around the prediction by the calibration's absolute errors."""
    q = conformal_quantile(calibration.select(F.abs(F.col(label) - F.col(prediction)).alias("score")), alpha).select(F.col("q").alias("_q"))
    return rows.crossJoin(F.broadcast(q)).withColumns({"lower": F.greatest(F.col(prediction) - F.col("_q"), F.lit(0.0)), "upper": F.col(prediction) + F.col("_q")}).drop("_q")


def cross_conformal(oof: DataFrame, *, label: str, alpha: float = 0.1, prediction: str = "prediction") -> DataFrame:
    """Adds lower and upper to out-of-fold predictions; a row's interval comes from the errors of the other folds."""
    n = oof.select("fold").distinct().count()
    if n < 2:
        raise ValueError("intervals need two folds")
    told = oof.select("fold", F.abs(F.col(label) - F.col(prediction)).alias("score"))
    folds = told.select("fold").distinct().withColumnRenamed("fold", "of")
    q = conformal_quantile(told.join(folds, F.col("fold") != F.col("of")), alpha, ["of"]).select(F.col("of").alias("fold"), F.col("q").alias("_q"))
    return oof.join(q, "fold").withColumns({"lower": F.greatest(F.col(prediction) - F.col("_q"), F.lit(0.0)), "upper": F.col(prediction) + F.col("_q")}).drop("_q")


def conformal_quantiles(calibration: DataFrame, rows: DataFrame, *, label: str, alpha: float = 0.1, low: str = "q05", high: str = "q95") -> DataFrame:
    """Conformalised quantiles: both ends move out by the quantile of how far the calibration's truths lie beyond them (in, where they lie inside)."""
    beyond = F.greatest(F.col(low) - F.col(label), F.col(label) - F.col(high)).alias("score")
    q = conformal_quantile(calibration.select(beyond), alpha).select(F.col("q").alias("_q"))
    return rows.crossJoin(F.broadcast(q)).withColumns({"lower": F.greatest(F.col(low) - F.col("_q"), F.lit(0.0)), "upper": F.col(high) + F.col("_q")}).drop("_q")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _numbered(rows: DataFrame, key: str, order: Column, n: int, as_name: str) -> DataFrame:
    """(key, fold): distinct keys in an order, dealt round-robin. Keys are stations, blocks or days: few."""
    keys = rows.select(key).distinct()
    return keys.withColumn(as_name, ((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key)) - 1) % n).cast("int"))


def _roles(rows: DataFrame, fold: str, n: int, extra: list[str] | None = None) -> DataFrame:
    """A row for each fold: test where it is the row's own, else train."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold")
    return rows.select("id", F.col(fold).alias("_own"), *(extra or []), every).withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))


def random_folds(rows: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(fold, id, role): by digest of the id."""
    own = rows.select("id", F.pmod(F.conv(F.substring(_draw(F.col("id"), seed), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int").alias("f"))
    return _roles(own, "f", n).select("fold", "id", "role")


def station_folds(rows: DataFrame, n: int | None = None, *, group: str = "station", seed: int = 42) -> DataFrame:
    """Whole stations held out: each alone, or dealt to n folds by digest."""
    if n is None:
        n = rows.select(group).distinct().count()
        order = F.col(group)
    else:
        order = _draw(F.col(group), seed)
    own = rows.join(_numbered(rows, group, order, n, "f"), group)
    return _roles(own, "f", n).select("fold", "id", "role")


def time_folds(rows: DataFrame, n: int = 5, *, time: str = "day") -> DataFrame:
    """Contiguous groups of distinct days; earlier groups take the remainder."""
    days = rows.select(time).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(time)
    k, m = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    big, rest = F.floor(m / n), m % n
    fold = F.when(k < rest * (big + 1), F.floor(k / (big + 1))).otherwise(rest + F.floor(F.try_divide(k - rest * (big + 1), F.greatest(big, F.lit(1)))))
    own = rows.join(days.withColumn("f", fold.cast("int")), time)
    return _roles(own, "f", n).select("fold", "id", "role")


def forward_folds(rows: DataFrame, n: int = 5, *, time: str = "day") -> DataFrame:
    """n + 1 time segments; fold k tests segment k + 1 and trains on all earlier ones."""
    segments = time_folds(rows, n + 1, time=time).filter("role = 'test'").select("id", F.col("fold").alias("seg"))
    out = segments.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("seg") == F.col("fold") + 1, "test").when(F.col("seg") <= F.col("fold"), "train")
    return out.withColumn("role", role).filter("role IS NOT NULL").select("fold", "id", "role")


def _blocks(rows: DataFrame, step: float) -> DataFrame:
    if step <= 0:
        raise ValueError("block size must be positive")
    low = rows.agg(F.min("lat").alias("_y"), F.min("lon").alias("_x"))
    block = F.concat_ws(":", F.floor((F.col("lat") - F.col("_y")) / step).cast("string"), F.floor((F.col("lon") - F.col("_x")) / step).cast("string"))
    return rows.crossJoin(F.broadcast(low)).withColumn("block", block).drop("_y", "_x")


def spatial_folds(rows: DataFrame, *, block_deg: float = 2.0, buffer_deg: float = 0.5, n: int = 4, seed: int = 42) -> DataFrame:
    """Blocks dealt to folds; train rows closer (Chebyshev, strictly) than the buffer to a test place are left out.

    Places, not rows, are compared, and only those in touching buckets.
    """
    blocked = _blocks(rows, block_deg)
    own = blocked.join(_numbered(blocked, "block", _draw(F.col("block"), seed), n, "f"), "block")
    roles = _roles(own, "f", n, ["lat", "lon"])
    if buffer_deg <= 0:
        return roles.select("fold", "id", "role")
    places = own.select("lat", "lon", "f").distinct()
    cell = lambda c: F.floor(F.col(c) / buffer_deg)
    around = F.explode(F.array(*(F.struct((cell("lat") + a).alias("a"), (cell("lon") + b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    tests = places.withColumn("c", around).select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), F.col("f").alias("fold"), "c.a", "c.b")
    near = places.select("lat", "lon", F.col("f").alias("own"), cell("lat").alias("a"), cell("lon").alias("b")).join(tests, ["a", "b"])
    near = near.filter((F.col("own") != F.col("fold")) & (F.greatest(F.abs(F.col("lat") - F.col("tlat")), F.abs(F.col("lon") - F.col("tlon"))) < buffer_deg)).select("fold", "lat", "lon").distinct().withColumn("close", F.lit(True))
    return roles.join(near, ["fold", "lat", "lon"], "left").filter("role = 'test' OR close IS NULL").select("fold", "id", "role")


def spatiotemporal_folds(rows: DataFrame, *, block_deg: float = 4.0, block_days: int = 14, n_space: int = 3, n_time: int = 3, buffer_days: int = 0, time: str = "day", seed: int = 42) -> DataFrame:
    """Space blocks and time blocks held out together; training leaves out both, and days within the buffer of held ones."""
    first = rows.agg(F.min(time).alias("_t0"))
    blocked = _blocks(rows, block_deg).crossJoin(F.broadcast(first)).withColumn("tb", F.floor(F.datediff(time, "_t0") / block_days)).drop("_t0")
    s = _numbered(blocked, "block", _draw(F.col("block"), seed), n_space, "sf")
    t = _numbered(blocked, "tb", _draw(F.col("tb"), seed + 1), n_time, "tf")
    own = blocked.join(s, "block").join(t, "tb")
    out = own.select("id", "sf", "tf", "tb", F.col(time).alias("day"), F.explode(F.sequence(F.lit(0), F.lit(n_space * n_time - 1))).alias("fold"))
    fs, ft = F.floor(F.col("fold") / n_time), F.col("fold") % n_time
    role = F.when((F.col("sf") == fs) & (F.col("tf") == ft), "test").when((F.col("sf") != fs) & (F.col("tf") != ft), "train")
    out = out.withColumn("role", role).filter("role IS NOT NULL")
    if buffer_days > 0:
        held = own.select(F.col("tf").alias("_tf"), F.explode(F.sequence(F.date_sub(time, buffer_days), F.date_add(time, buffer_days))).alias("day")).distinct().withColumn("close", F.lit(True))
        out = out.withColumn("_tf", ft).join(held, ["_tf", "day"], "left").filter("role = 'test' OR close IS NULL")
    return out.select("fold", "id", "role")


def folds(scheme: str, rows: DataFrame, **more) -> DataFrame:  # noqa: ANN003
    schemes = {"random": random_folds, "leave_station_out": station_folds, "leave_time_out": time_folds, "forward_chaining": forward_folds, "spatial_block": spatial_folds, "spatiotemporal": spatiotemporal_folds}
    if scheme not in schemes:
        raise ValueError(f"unknown scheme {scheme!r}; one of {sorted(schemes)}")
    return schemes[scheme](rows, **more)


def cross_validate(rows: DataFrame, columns: list[str], label: str, split: DataFrame, *, kind: str = "linear", seed: int = 42, **more) -> DataFrame:  # noqa: ANN003
    """(fold, id, label, prediction): out-of-fold predictions, a fit a fold. Rows that share an id share its fold."""
    split = keep(split, "split")
    out = None
    for f in sorted(r[0] for r in split.select("fold").distinct().collect()):
        part = split.filter(F.col("fold") == f)
        model = fit(rows.join(part.filter("role = 'train'").select("id"), "id", "left_semi"), columns, label, kind, seed=seed, **more)
        held = predict(model, rows.join(part.filter("role = 'test'").select("id"), "id", "left_semi"), columns).select(F.lit(f).alias("fold"), "id", label, "prediction")
        out = held if out is None else out.unionByName(held)
    return out


def fold_summary(oof: DataFrame, label: str) -> DataFrame:
    """(metric, mean, std) over folds; the deviation is the population's."""
    each = metrics_table(oof, ["fold"], y=label, p="prediction")
    names = ["r", "r2", "rmse", "mae", "mbe", "nmb", "nme", "ioa"]
    long = each.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in names))).alias("e")).select("e.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def cv_ladder(rows: DataFrame, columns: list[str], label: str, schemes: dict[str, dict], *, kind: str = "linear", metric: str = "r") -> DataFrame:
    """(scheme, metrics.., leakage_vs_random): pooled out-of-fold metrics of each scheme."""
    out = None
    for name, more in schemes.items():
        table = metrics_table(cross_validate(rows, columns, label, folds(name, rows, **more), kind=kind), y=label, p="prediction").withColumn("scheme", F.lit(name))
        out = table if out is None else out.unionByName(table)
    base = out.filter("scheme = 'random'").agg(F.max(metric).alias("_b"))
    return out.crossJoin(F.broadcast(base)).withColumn("leakage_vs_random", F.col("_b") - F.col(metric)).drop("_b")


def residual_correction(rows: DataFrame, columns: list[str], *, sat: str = "sat", obs: str = "obs", kind: str = "boosted") -> DataFrame:
    """Adds corrected: the satellite value plus the predicted residual; a missing value stays missing."""
    known = rows.withColumn("_res", clean(F.col(obs)) - clean(F.col(sat)))
    model = fit(known, columns, "_res", kind)
    out = model.transform(known.withColumns({c: clean(F.col(c)) for c in columns}))
    return out.withColumn("corrected", clean(F.col(sat)) + F.col("prediction")).select(*rows.columns, "corrected")


def impute_anchor(rows: DataFrame, anchor: str, others: list[str], fallback: str, *, least: int = 50, seed: int = 42, **more) -> DataFrame:  # noqa: ANN003
    """Adds imputed: the anchor sensor's value, else a forest's from the others where one is there, else the fallback column.

    The forest learns where the anchor and another are present; with fewer than
    ``least`` such rows the fallback takes its place.
    """
    some = F.lit(False)
    for c in others:
        some = some | clean(F.col(c)).isNotNull()
    there = clean(F.col(anchor))
    train = rows.filter(there.isNotNull() & some)
    if train.count() < least:
        return rows.withColumn("imputed", F.coalesce(there, clean(F.col(fallback))))
    model = fit(train, others, anchor, "forest", seed=seed, **more)
    out = model.transform(rows.withColumns({c: clean(F.col(c)) for c in others}).withColumn("_anchor", there))
    return out.withColumn("imputed", F.coalesce("_anchor", F.when(some, F.col("prediction")), clean(F.col(fallback)))).select(*rows.columns, "imputed")


__all__ = ["blend", "blend_weights", "conformal_intervals", "conformal_quantiles", "cross_conformal", "cross_validate", "cv_ladder", "fit", "fold_summary", "folds", "importances", "impute_anchor", "load_model", "predict", "predict_many", "residual_correction", "save_model", "tree_quantiles", "vector_to_array"]

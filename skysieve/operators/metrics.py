"""Agreement metrics, confusion tables, conformal intervals, coverage, applicability."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.aqi import category_index, clean
from skysieve.operators.ranks import cumulative


def clean_pairs(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows where both numbers are finite."""
    return df.withColumns({y: clean(F.col(y)), p: clean(F.col(p))}).filter(F.col(y).isNotNull() & F.col(p).isNotNull())


def _metric_columns(y: Column, p: Column, mean: Column) -> dict[str, Column]:
    n, d = F.count(F.lit(1)), p - y
    sxx, syy, sxy = (F.covar_pop(a, b) * n for a, b in ((y, y), (p, p), (y, p)))
    sse, sst = F.sum(d * d), F.sum((y - mean) * (y - mean))
    var_y, var_p = F.var_pop(y), F.var_pop(p)
    slope = F.when(F.abs(sxy) > 0, (syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy))
    return {
        "n": n, "r": F.when((n >= 2) & (var_y > 0) & (var_p > 0), F.covar_pop(y, p) / F.sqrt(var_y * var_p)),
        "r2": F.when(sst > 0, 1 - F.try_divide(sse, sst)), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "mbe": F.avg(d),
        "nmb": F.try_divide(F.sum(d), F.sum(y)), "nme": F.try_divide(F.sum(F.abs(d)), F.sum(y)),
        "ioa": 1 - F.try_divide(sse, F.sum((F.abs(p - mean) + F.abs(y - mean)) * (F.abs(p - mean) + F.abs(y - mean)))),
        "slope": slope, "intercept": F.avg(p) - slope * F.avg(y),
    }


def metrics_table(df: DataFrame, by: list[str] | None = None, *, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """n, r, r2, rmse, mae, mbe, nmb, nme, ioa, and the orthogonal-regression slope and intercept, in all or by group.

    One pass for the groups' means, which are joined back, and one for the rest.
    """
    by = by or []
    pairs = clean_pairs(df, y, p)
    mean = pairs.groupBy(*by).agg(F.avg(y).alias("_mean"))
    joined = pairs.join(mean, by) if by else pairs.crossJoin(F.broadcast(mean))  # one row without groups
    cols = _metric_columns(F.col(y), F.col(p), F.col("_mean"))
    return joined.groupBy(*by).agg(*(c.alias(k) for k, c in cols.items()))


def stratified_metrics(df: DataFrame, bands: list[tuple[float, float]], *, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Metrics by half-open band of the truth; bands may overlap, empty ones are left out."""
    hit = F.filter(F.array(*(F.when((F.col(y) >= a) & (F.col(y) < b), F.lit(f"{a:g}-{b:g}")) for a, b in bands)), lambda x: x.isNotNull())
    return metrics_table(clean_pairs(df, y, p).withColumn("band", F.explode(hit)), ["band"], y=y, p=p)


def confusion(df: DataFrame, *, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(true_band, predicted_band, n) over rows with both bands."""
    rows = df.select(category_index(F.col(y)).cast("int").alias("true_band"), category_index(F.col(p)).cast("int").alias("predicted_band")).filter("true_band >= 0 AND predicted_band >= 0")
    return rows.groupBy("true_band", "predicted_band").agg(F.count(F.lit(1)).alias("n"))


def normalised_confusion(table: DataFrame, normalize: str | None = None) -> DataFrame:
    """The table with ``share`` of the true band, the predicted band, or all."""
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    if normalize is None:
        return table.withColumn("share", F.col("n").cast("double"))
    by = {"true": ["true_band"], "pred": ["predicted_band"], "all": []}[normalize]
    return table.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))  # at most 36 rows


def class_scores(table: DataFrame) -> DataFrame:
    """(band, support, precision, recall, f1) for the six bands."""
    bands = table.sparkSession.range(6).select(F.col("id").cast("int").alias("band"))
    hit = F.sum(F.when((F.col("true_band") == F.col("band")) & (F.col("predicted_band") == F.col("band")), F.col("n")).otherwise(0))
    true, pred = (F.sum(F.when(F.col(c) == F.col("band"), F.col("n")).otherwise(0)) for c in ("true_band", "predicted_band"))
    out = bands.join(table, (F.col("band") == F.col("true_band")) | (F.col("band") == F.col("predicted_band")), "left").groupBy("band").agg(hit.alias("hit"), F.coalesce(true, F.lit(0)).alias("support"), F.coalesce(pred, F.lit(0)).alias("predicted"))
    precision, recall = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("band", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def accuracy(table: DataFrame, scores: DataFrame) -> DataFrame:
    """(accuracy, hazardous_recall): the latter is the mean recall of the three worst bands that occur."""
    acc = table.agg(F.try_divide(F.sum(F.when(F.col("true_band") == F.col("predicted_band"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    bad = scores.filter("band >= 3 AND support > 0").agg(F.avg("recall").alias("hazardous_recall"))
    return acc.crossJoin(bad)


def conformal_level(n: int, alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


def conformal_quantile(scores: DataFrame, alpha: float = 0.1, by: list[str] | None = None, *, score: str = "score") -> DataFrame:
    """(group, q, n): the score of 0-based rank ceil(level (n - 1)) in ascending order.

    The rank is exact and found from counts per distinct score, dealt by range, so
    neither a group nor the whole column is ever sorted in one task.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    by = by or []
    s = scores.withColumn(score, clean(F.col(score))).filter(F.col(score).isNotNull())
    sizes = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    counted = s.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    ranked = cumulative(counted, score, "_c", by)
    joined = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))
    return joined.filter(F.col("upto") > F.ceil(level * (F.col("n") - 1))).groupBy(*by).agg(F.min(score).alias("q"), F.first("n").alias("n"))


def mondrian_intervals(points: DataFrame, calibration: DataFrame, group: str, alpha: float = 0.1, *, point: str = "y_pred") -> DataFrame:
    """Adds lower and upper by the group's quantile, the global one for groups not calibrated."""
    each = conformal_quantile(calibration, alpha, [group]).select(group, F.col("q").alias("_q"))
    whole = conformal_quantile(calibration, alpha).select(F.col("q").alias("_g"))
    out = points.join(each, group, "left").crossJoin(F.broadcast(whole))
    q = F.coalesce("_q", "_g")
    return out.withColumns({"lower": F.col(point) - q, "upper": F.col(point) + q}).drop("_q", "_g")


def coverage_report(df: DataFrame, alpha: float = 0.1, *, y: str = "y_true") -> DataFrame:
    """(picp, mpiw, target, gap, n) over rows where truth and both ends are finite."""
    rows = df.select(clean(F.col(y)).alias("y"), clean(F.col("lower")).alias("lo"), clean(F.col("upper")).alias("hi")).na.drop()
    picp = F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))
    return rows.agg(picp.alias("picp"), F.avg(F.col("hi") - F.col("lo")).alias("mpiw"), F.lit(1 - alpha).alias("target"), (picp - (1 - alpha)).alias("gap"), F.count(F.lit(1)).alias("n"))


def applicability(train: DataFrame, query: DataFrame, columns: list[str], *, n_std: float = 3.0, most: float = 0.25) -> DataFrame:
    """Adds applicable: at most a share of the columns is missing or beyond ``n_std`` training deviations."""
    stats = train.agg(*(F.avg(clean(F.col(c))).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(clean(F.col(c))).alias(f"_s_{c}") for c in columns))

    def out(c: str) -> Column:
        sd = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        return F.when(F.abs((clean(F.col(c)) - F.col(f"_m_{c}")) / sd) <= n_std, 0).otherwise(1)

    far = reduce(lambda a, b: a + b, (out(c) for c in columns)) / F.lit(float(len(columns)))
    return query.crossJoin(F.broadcast(stats)).withColumn("applicable", far <= most).drop(*(f"_{k}_{c}" for k in "ms" for c in columns))

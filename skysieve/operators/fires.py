"""Fire series: daily totals, decomposition, episodes, lagged correlation, emissions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysieve.constants import CONSUMPTION, DAY_SECONDS, EMISSION_FACTORS, INDIA_BOX, INVENTORIES
from skysieve.functions.aqi import clean
from skysieve.functions.physics import burning_season, in_box
from skysieve.operators.scratch import keep


def clip_to_box(fires: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    return fires if box is None else fires.filter(in_box(F.col("lat"), F.col("lon"), box))


def daily_series(fires: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(date, fire_count, frp_sum) for every day from the first to the last, 0 where nothing burnt."""
    days = clip_to_box(fires, box).groupBy(F.to_date("date").alias("date")).agg(F.count(F.lit(1)).alias("fire_count"), F.sum("frp").alias("frp_sum"))
    spine = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date"))
    zero = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (("fire_count", 0), ("frp_sum", 0.0))}
    return spine.join(days, "date", "left").withColumns(zero)


def _whole(order: str):  # noqa: ANN202
    """A window over a daily series: one row a day, so one task holds it."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def decompose(series: DataFrame, period: int, value: str = "frp_sum", time: str = "date") -> DataFrame:
    """Adds trend, seasonal, residual: a centred moving average over an odd window, zeros beyond the ends, and the mean by phase, re-centred."""
    half = (period if period % 2 else period + 1) // 2
    w = _whole(time)
    out = series.withColumn("i", F.row_number().over(w) - 1).withColumn("trend", F.sum(value).over(w.rowsBetween(-half, half)) / F.lit(float(2 * half + 1)))
    phase = Window.partitionBy(F.pmod("i", F.lit(period)))
    out = out.withColumn("raw", F.avg(F.col(value) - F.col("trend")).over(phase))
    phases = out.select(F.pmod("i", F.lit(period)).alias("ph"), "raw").distinct().agg(F.avg("raw").alias("center"))
    out = out.crossJoin(F.broadcast(phases)).withColumn("seasonal", F.col("raw") - F.col("center"))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("raw", "center", "i")


def runs_above(df: DataFrame, flag: str, time: str, least: int) -> DataFrame:
    """Adds run: an id of each maximal run of true flags of at least ``least`` rows, null elsewhere."""
    w = _whole(time)
    out = df.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.when(F.col(flag), F.col("_i") - F.sum(F.col(flag).cast("int")).over(w)))
    size = F.count(F.lit(1)).over(Window.partitionBy("_k"))
    return out.withColumn("run", F.when(F.col(flag) & (size >= least), F.col("_k"))).drop("_i", "_k")


def episodes(fires: DataFrame, box: tuple[float, float, float, float] | None = None, *, period: int = 365, sigma: float = 1.5, least: int = 2) -> DataFrame:
    """(start, end, duration_days, peak_date, peak_frp, total_frp, mean_residual_sigma, season) of runs of days far above the decomposed series.

    The period is at most half the series; the deviation is the population's.
    """
    series = keep(daily_series(fires, box), "series")
    n = series.count()
    if n == 0:
        raise ValueError("no fire in the box")
    out = decompose(series, max(1, min(period, n // 2)))
    sd = out.agg(F.stddev_pop("residual").alias("sd"))
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    out = out.crossJoin(F.broadcast(sd)).withColumn("residual_sigma", F.col("residual") / scale).withColumn("above", F.col("residual_sigma") > sigma)
    run = runs_above(out, "above", "date", least).filter("run IS NOT NULL")
    first = F.struct(F.col("residual_sigma"), -F.unix_date("date"))
    return run.groupBy("run").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("duration_days"), F.max_by("date", first).alias("peak_date"),
        F.max_by("frp_sum", first).alias("peak_frp"), F.sum("frp_sum").alias("total_frp"), F.avg("residual_sigma").alias("mean_residual_sigma"),
    ).withColumn("season", burning_season(F.col("start"))).drop("run")


def deseasonalise(series: DataFrame, value: str, time: str = "date", window: int = 15) -> DataFrame:
    """Takes a centred moving average off, the series mirrored at its ends (the end row itself repeats)."""
    half = window // 2
    w = _whole(time)
    rows = series.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    ghosts = F.array(F.col("_i"), F.when(F.col("_i") <= half, 1 - F.col("_i")), F.when(F.col("_i") > F.col("_n") - half, 2 * F.col("_n") + 1 - F.col("_i")))
    padded = rows.withColumn("_at", F.explode(F.filter(ghosts, lambda x: x.isNotNull())))
    mean = F.avg(value).over(Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(-half, half))
    return padded.withColumn(value, F.col(value) - mean).filter("_at = _i").drop("_i", "_n", "_at")


def lagged_correlation(pairs: DataFrame, a: str, b: str, *, time: str = "date", max_lag: int = 7, deseason: bool = True, window: int = 15) -> DataFrame:
    """(lag, n, r): a at t against b at t + lag. ``is_peak`` marks the largest r among lags of 0 and more."""
    n = pairs.count()
    if n <= max_lag + 1:
        raise ValueError("series too short for the lags")
    rows = pairs.select(time, F.col(a).alias("a"), F.col(b).alias("b"))
    if deseason:
        rows = deseasonalise(deseasonalise(rows, "a", time, window), "b", time, window)
    rows = rows.withColumn("i", F.row_number().over(_whole(time)))
    left = rows.select("i", "a").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("i", F.col("i") + F.col("lag"))
    ok = (F.count(F.lit(1)) >= 3) & (F.var_pop("a") > 0) & (F.var_pop("b") > 0)
    r = F.when(ok, F.covar_pop("a", "b") / F.sqrt(F.var_pop("a") * F.var_pop("b")))
    out = left.join(rows.select("i", "b"), "i").groupBy("lag").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    peak = out.filter("lag >= 0 AND r IS NOT NULL").agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("peak"))
    return out.crossJoin(F.broadcast(peak)).withColumn("is_peak", F.col("lag") == F.col("peak")).drop("peak")


def slope(pairs: DataFrame, frp: str, hcho: str, *, quantile: float = 0.1) -> DataFrame:
    """(n, background, slope, intercept, r, r2) of HCHO above its low quantile on fire power."""
    rows = pairs.select(clean(F.col(frp)).alias("x"), clean(F.col(hcho)).alias("y")).na.drop()
    ok = (F.count(F.lit(1)) >= 3) & (F.var_pop("x") > 0)
    sl = F.when(ok, F.covar_pop("x", "y") / F.var_pop("x"))
    r = F.when(ok & (F.var_pop("y") > 0), F.covar_pop("x", "y") / F.sqrt(F.var_pop("x") * F.var_pop("y")))
    bg = F.when(F.count(F.lit(1)) >= 3, F.percentile("y", F.lit(quantile)))
    return rows.agg(F.count(F.lit(1)).alias("n"), bg.alias("background"), sl.alias("slope"), (F.avg("y") - bg - sl * F.avg("x")).alias("intercept"), r.alias("r"), (r * r).alias("r2"))


def coefficient(species: str, biome: str = "crop_residue", *, seconds: float = DAY_SECONDS) -> float:
    """Kilograms of a species for each megawatt."""
    return CONSUMPTION * seconds * EMISSION_FACTORS[biome][species] / 1000.0


def emission_rates(fires: DataFrame, species: tuple[str, ...] = ("hcho", "nmvoc", "co", "pm25"), *, biome: str = "crop_residue", frp: str = "frp", seconds: float = DAY_SECONDS, scaling: float = 1.0) -> DataFrame:
    return fires.withColumns({f"emis_{s}_kg": F.col(frp) * coefficient(s, biome, seconds=seconds) * scaling for s in species})


def box_cell(lat, lon, box: tuple[float, float, float, float], step: float):  # noqa: ANN001, ANN201
    """(i, j, inside): left-closed bins of a box, the last one closed on both sides."""
    n_lat, n_lon = (math.ceil(round((box[k + 2] - box[k]) / step, 9)) for k in (1, 0))
    i, j = (F.least(F.floor((v - lo) / step), F.lit(n - 1)) for v, lo, n in ((lat, box[1], n_lat), (lon, box[0], n_lon)))
    return i, j, in_box(lat, lon, box)


def grid_emissions(fires: DataFrame, species: str = "hcho", *, box: tuple[float, float, float, float] = INDIA_BOX, step: float = 0.25, biome: str = "crop_residue", inventory: str = "FINN") -> DataFrame:
    """(i, j, lat, lon, emission_kg, n) summed over cells; what lies outside is dropped."""
    rows = emission_rates(fires, (species,), biome=biome, scaling=INVENTORIES[inventory])
    i, j, inside = box_cell(F.col("lat"), F.col("lon"), box, step)
    out = rows.filter(inside).groupBy(i.alias("i"), j.alias("j")).agg(F.sum(f"emis_{species}_kg").alias("emission_kg"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({"lat": box[1] + (F.col("i") + 0.5) * step, "lon": box[0] + (F.col("j") + 0.5) * step})


def inventory_ensemble(fires: DataFrame, species: str = "hcho", *, biome: str = "crop_residue", scalings: dict[str, float] | None = None) -> DataFrame:
    """(inventory, total_kg) and the ensemble's central (median), low, high and spread: one sum, scaled."""
    scalings = scalings or INVENTORIES
    total = fires.agg((F.sum("frp") * coefficient(species, biome)).alias("base"))
    each = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("inventory"), (F.col("base") * v).alias("total_kg")) for k, v in scalings.items()))).alias("x")).select("x.*")
    ends = each.agg(F.median("total_kg").alias("central"), F.min("total_kg").alias("low"), F.max("total_kg").alias("high"))
    return each.crossJoin(F.broadcast(ends)).withColumn("spread", F.try_divide("high", "low"))


def granger(pairs: DataFrame, a: str, b: str, *, time: str = "date", max_lag: int = 3, prewhiten: bool = True) -> DataFrame:
    """(lag, f, p, available): F tests that a helps to predict b, on first differences.

    One series is one group; a daily series is small by nature.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        if prewhiten:
            x, y = np.diff(x), np.diff(y)
        out = []
        for lag in range(1, max_lag + 1):
            n = len(y) - lag
            k = 2 * lag + 1
            if n <= k + 1:
                out.append((lag, None, None, False))
                continue
            past = lambda v, n=n, lag=lag: [v[lag - m : lag - m + n] for m in range(1, lag + 1)]
            sse = []
            for cols in ([np.ones(n), *past(y)], [np.ones(n), *past(y), *past(x)]):
                m = np.column_stack(cols)
                beta, *_ = np.linalg.lstsq(m, y[lag:], rcond=None)
                sse.append(float(((y[lag:] - m @ beta) ** 2).sum()))
            f = (sse[0] - sse[1]) / lag / (sse[1] / (n - k)) if sse[1] > 0 else math.inf
            out.append((lag, f, f_tail(f, lag, n - k), True))
        return pd.DataFrame(out, columns=["lag", "f", "p", "available"])

    rows = pairs.select(F.lit(0).alias("g"), F.col(time).alias("t"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop()
    return rows.groupBy("g").applyInPandas(test, "lag int, f double, p double, available boolean")


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f), by the continued fraction of the incomplete beta function."""
    if not math.isfinite(f):
        return 0.0
    return beta_part(d2 / (d2 + d1 * max(f, 0.0)), d2 / 2, d1 / 2)


def beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for m in range(400):
        k = m // 2
        num = 1.0 if m == 0 else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)

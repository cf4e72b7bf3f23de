"""Grids as long rows (i, j, t, value): anomalies, composites, mapping, gap filling, regridding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.constants import EARTH_KM
from skysieve.functions.aqi import clean
from skysieve.functions.physics import season_of
from skysieve.operators.nearest import nearest
from skysieve.operators.ranks import quantiles

CELL = ["i", "j"]


def robust_z(cube: DataFrame, *, by: list[str] = CELL, value: str = "v", least: int = 3) -> DataFrame:
    """Adds median, scale, z over each cell's series: (x - median) / (1.4826 MAD); null for a scale of 0 or short series."""
    rows = cube.withColumn(value, clean(F.col(value)))
    med = rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    away = rows.join(med, by).withColumn("away", F.abs(F.col(value) - F.col("median")))
    scale = away.groupBy(*by).agg((F.median("away") * 1.4826).alias("scale"))
    z = F.when((F.col("scale") > 0) & (F.col("n") >= least), F.try_divide(F.col(value) - F.col("median"), F.col("scale")))
    return away.join(scale, by).withColumn("z", z).drop("away")


def percentile_surface(cube: DataFrame, q: float = 95.0, *, by: list[str] = CELL, value: str = "v") -> DataFrame:
    return cube.groupBy(*by).agg(F.percentile(clean(F.col(value)), F.lit(q / 100)).alias("percentile"))


def polynomial_surface(field: DataFrame, degree: int = 2, *, value: str = "v", x: str = "j", y: str = "i") -> DataFrame:
    """Adds fitted: a least-squares polynomial in the coordinates scaled to -1..1.

    The normal equations come from one aggregation; the solved coefficients are
    a handful of numbers.
    """
    ends = field.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scale = lambda c: F.lit(0.0) if ends[f"hi_{c}"] == ends[f"lo_{c}"] else 2 * (F.col(c) - ends[f"lo_{c}"]) / (ends[f"hi_{c}"] - ends[f"lo_{c}"]) - 1
    terms = [(a, b) for a in range(degree + 1) for b in range(degree + 1 - a)]
    basis = [F.pow(scale(x), F.lit(float(a))) * F.pow(scale(y), F.lit(float(b))) for a, b in terms]
    v = clean(F.col(value))
    sums = field.filter(v.isNotNull()).agg(*(F.sum(basis[p] * basis[q]).alias(f"a{p}_{q}") for p in range(len(terms)) for q in range(p + 1)), *(F.sum(basis[p] * v).alias(f"b{p}") for p in range(len(terms)))).first()
    m = np.array([[sums[f"a{max(p, q)}_{min(p, q)}"] or 0.0 for q in range(len(terms))] for p in range(len(terms))])
    coef, *_ = np.linalg.lstsq(m, np.array([sums[f"b{p}"] or 0.0 for p in range(len(terms))]), rcond=None)
    fitted = F.lit(0.0)
    for c, b in zip(coef, basis, strict=True):
        fitted = fitted + float(c) * b
    return field.withColumn("fitted", fitted)


def spatial_anomaly(field: DataFrame, *, value: str = "v", degree: int | None = 2) -> DataFrame:
    """Adds z_spatial: the robust z over the whole field, after taking a polynomial surface off (None: not)."""
    rows = polynomial_surface(field, degree, value=value).withColumn("_r", clean(F.col(value)) - F.col("fitted")) if degree else field.withColumn("_r", clean(F.col(value)))
    middle = quantiles(rows, "_r", [0.5])[0]
    away = quantiles(rows.select(F.abs(F.col("_r") - F.lit(middle)).alias("_a")), "_a", [0.5])[0]
    scale = 1.4826 * (away or 0.0)
    z = (F.col("_r") - middle) / scale if scale > 0 else F.lit(None).cast("double")
    return rows.withColumn("z_spatial", z).drop("_r", "fitted")


def climatology(cube: DataFrame, season: str | None = None, *, value: str = "v", q: float = 95.0, time: str = "t") -> DataFrame:
    """Adds z, median, scale, mean, percentile and exceeds (value at or above the cell's percentile) to the season's rows."""
    rows = cube if season is None else cube.filter(season_of(F.col(time)) == season)
    if rows.isEmpty():
        raise ValueError(f"no row in season {season!r}")
    stats = rows.groupBy(*CELL).agg(F.avg(clean(F.col(value))).alias("mean"), F.percentile(clean(F.col(value)), F.lit(q / 100)).alias("percentile"))
    return robust_z(rows, value=value).join(stats, CELL).withColumn("exceeds", F.col(value) >= F.col("percentile"))


def weighted_composite(stack: DataFrame, weights: dict[str, float], *, by: list[str], source: str = "source", value: str = "v") -> DataFrame:
    """(by, fused, provenance, uncertainty): weighted mean of the sources present, the heaviest one's place (-1: none), and the weighted spread times (1 + 1/n)."""
    place = {s: k for k, s in enumerate(weights)}
    pick = lambda d: F.coalesce(*(F.when(F.col(source) == s, F.lit(x)) for s, x in d.items()))
    rows = stack.withColumns({"_w": pick({s: float(w) for s, w in weights.items()}), "_k": pick(place), "_v": clean(F.col(value))})
    has = F.col("_v").isNotNull()
    w = F.when(has, F.col("_w"))
    fused = rows.groupBy(*by).agg(
        F.try_divide(F.sum(w * F.col("_v")), F.sum(w)).alias("fused"),
        F.coalesce(F.max_by(F.when(has, F.col("_k")), F.when(has, F.struct("_w", -F.col("_k")))), F.lit(-1)).alias("provenance"), F.count("_v").alias("_n"),
    )
    spread = rows.join(fused.select(*by, "fused"), by).groupBy(*by).agg(F.try_divide(F.sum(w * F.pow(F.col("_v") - F.col("fused"), 2)), F.sum(w)).alias("_var"))
    return fused.join(spread, by).withColumn("uncertainty", F.when(F.col("_n") > 0, F.sqrt("_var") * (1 + 1.0 / F.col("_n")))).select(*by, "fused", "provenance", "uncertainty")


def fit_quantile_map(pairs: DataFrame, *, sat: str = "sat", obs: str = "obs", region: str | None = None, n: int = 100, least: int = 30) -> DataFrame:
    """(region, sat_q, obs_q): paired quantile arrays, for all rows (null region) and for regions with enough rows."""
    rows = pairs.withColumns({"s": clean(F.col(sat)), "o": clean(F.col(obs))}).filter("s IS NOT NULL AND o IS NOT NULL")
    probs = [k / (n - 1) for k in range(n)]
    told = "region string, sat_q array<double>, obs_q array<double>"
    whole = pairs.sparkSession.createDataFrame([(None, quantiles(rows, "s", probs), quantiles(rows, "o", probs))], told)
    if region is None:
        return whole
    q = [F.percentile(c, F.array(*map(F.lit, probs))).alias(f"{a}_q") for c, a in (("s", "sat"), ("o", "obs"))]
    each = rows.groupBy(F.col(region).cast("string").alias("region")).agg(*q, F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("region").isNotNull()).drop("n")
    return whole.unionByName(each)


#: Regions whose maps travel with the tasks; beyond, rows meet their region's map in a join.
FEW_MAPS = 10_000


def _mapped(x: np.ndarray, s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Linear between the quantiles, the end segments' slopes beyond them; where two quantiles are one, the lower's value."""
    k = np.clip(np.searchsorted(s, x, side="right") - 1, 0, len(s) - 2)
    width = s[k + 1] - s[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(width == 0, o[k], o[k] + (x - s[k]) * (o[k + 1] - o[k]) / width)
    return np.where(np.isfinite(x), out, np.nan)


def apply_quantile_map(rows: DataFrame, mapping: DataFrame, *, sat: str = "sat", region: str | None = None) -> DataFrame:
    """Adds mapped: linear between the quantiles, the end segments' slopes beyond them; unknown regions use the map of all."""
    x = clean(F.col(sat))
    if mapping.limit(FEW_MAPS + 1).count() <= FEW_MAPS:
        maps = {r["region"]: (np.array(r["sat_q"], float), np.array(r["obs_q"], float)) for r in mapping.collect()}

        @F.pandas_udf("double")
        def mapped(x: pd.Series, name: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            values, (codes, names) = x.to_numpy(float), pd.factorize(name, use_na_sentinel=False)
            for code, key in enumerate(names):
                at = codes == code
                s, o = maps.get(None if pd.isna(key) else key) or maps[None]
                out[at] = _mapped(values[at], s, o)
            return pd.Series(out)

        name = F.col(region).cast("string") if region is not None else F.lit(None).cast("string")
        return rows.withColumn("mapped", clean(mapped(x, name)))
    whole = mapping.filter("region IS NULL").select(F.col("sat_q").alias("_ws"), F.col("obs_q").alias("_wo"))
    each = mapping.filter("region IS NOT NULL").select(F.col("region").alias("_region"), F.col("sat_q").alias("_rs"), F.col("obs_q").alias("_ro"))
    name = F.col(region).cast("string") if region is not None else F.lit(None).cast("string")
    out = rows.crossJoin(F.broadcast(whole)).withColumn("_name", name)
    out = out.join(each, F.col("_name") == F.col("_region"), "left").withColumns({"_ws": F.coalesce("_rs", "_ws"), "_wo": F.coalesce("_ro", "_wo")})

    @F.pandas_udf("double")
    def mapped_by(x: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([float(_mapped(np.array([a]), np.asarray(b, float), np.asarray(c, float))[0]) for a, b, c in zip(x, s, o, strict=True)], dtype=float)

    return out.withColumn("mapped", clean(mapped_by(x, "_ws", "_wo"))).drop("_name", "_region", "_rs", "_ro", "_ws", "_wo")


def gap_report(cube: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, missing, gap_fraction)."""
    long = cube.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), clean(F.col(c)).isNull().cast("int").alias("gap")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").cast("long").alias("missing"), F.avg("gap").alias("gap_fraction"))


def mean_fill(cube: DataFrame, *, value: str = "v") -> DataFrame:
    """Adds filled: the value, else its cell's mean over time, else the mean of all, else 0."""
    v = clean(F.col(value))
    cells = cube.groupBy(*CELL).agg(F.avg(v).alias("_c"))
    whole = cube.agg(F.avg(v).alias("_a"))
    return cube.join(cells, CELL).crossJoin(F.broadcast(whole)).withColumn("filled", F.coalesce(v, "_c", "_a", F.lit(0.0))).drop("_c", "_a")


def time_fill(cube: DataFrame, *, value: str = "v", by: list[str] = CELL, time: str = "t") -> DataFrame:
    """Adds filled: forward, then backward in the cell's series, then the mean of all."""
    v, w = clean(F.col(value)), Window.partitionBy(*by).orderBy(time)
    whole = cube.agg(F.avg(v).alias("_a"))
    ahead = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(v, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return cube.crossJoin(F.broadcast(whole)).withColumn("filled", F.coalesce(ahead, back, "_a")).drop("_a")


def box_mean(field: DataFrame, radius: int = 1, *, value: str = "v") -> DataFrame:
    """Adds box_mean: the mean over (2r + 1)^2 cells, the field's edge repeated outward. Each cell is sent to its neighbours; no join."""
    n = field.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.min("i").alias("i0"), F.min("j").alias("j0"))

    def reach(c: str) -> Column:
        lo, hi = F.col(f"{c}0"), F.col(f"{c}1")
        steps = F.sequence(F.col(c) - radius, F.col(c) + radius)
        inner = F.transform(steps, lambda t: F.struct(t.alias("to"), F.lit(1).alias("times")))
        # An edge cell also stands for the rows beyond it.
        edge = lambda t: F.when((F.col(c) == lo) & (t <= lo + radius), lo - (t - radius)).otherwise(0) + F.when((F.col(c) == hi) & (t >= hi - radius), (t + radius) - hi).otherwise(0)
        return F.filter(F.transform(inner, lambda s: F.struct(s["to"].alias("to"), (1 + edge(s["to"])).alias("times"))), lambda s: (s["to"] >= lo) & (s["to"] <= hi))

    rows = field.crossJoin(F.broadcast(n.select(F.col("i").alias("i1"), F.col("j").alias("j1"), "i0", "j0")))
    sent = rows.withColumn("a", F.explode(reach("i"))).withColumn("b", F.explode(reach("j")))
    times = F.col("a.times") * F.col("b.times")
    means = sent.filter(clean(F.col(value)).isNotNull()).groupBy(F.col("a.to").alias("i"), F.col("b.to").alias("j")).agg((F.sum(clean(F.col(value)) * times) / F.sum(times)).alias("box_mean"))
    return field.join(means, CELL, "left")


def _plane(df: DataFrame, lat0: float, lon0: float, *keep: str) -> DataFrame:
    """The columns with x and y: kilometres on a local equirectangular plane."""
    return df.select(*keep, (F.radians(F.col("lon") - lon0) * math.cos(math.radians(lat0)) * EARTH_KM).alias("x"), (F.radians(F.col("lat") - lat0) * EARTH_KM).alias("y"))


def idw(obs: DataFrame, nodes: DataFrame, *, k: int = 8, power: float = 2.0, smoothing: float = 0.0) -> DataFrame:
    """(node, estimate, variance): inverse-distance weights of the k nearest observations in a local equirectangular plane.

    ``obs``: id, lat, lon, v. ``nodes``: node, lat, lon. Neighbours come from
    ``nearest``, so no node meets all observations. The plane's middle is summed in
    decimals: in doubles its last digits hang on the order of rows, and with them
    which of two places that mirror each other around a node is the nearer.
    """
    o = obs.filter(clean(F.col("v")).isNotNull())
    middle = o.agg(*(F.avg(clean(F.col(c)).try_cast("decimal(30,18)")).cast("double").alias(c) for c in ("lat", "lon"))).first()
    if middle["lat"] is None:
        raise ValueError("no observation")
    near = nearest(_plane(nodes, *middle, "node"), _plane(o, *middle, "id"), k).join(o.select("id", "v"), "id")
    w = 1.0 / F.pow(F.col("d") * F.col("d") + smoothing + 1e-12, F.lit(power / 2))
    est = near.groupBy("node").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("estimate"), F.avg("d").alias("_md"), (F.sum(w * F.col("v") * F.col("v")) / F.sum(w)).alias("_m2"))
    typical = quantiles(est, "_md", [0.5])[0] or 0.0
    var = F.greatest(F.col("_m2") - F.col("estimate") * F.col("estimate"), F.lit(0.0)) * (1 + F.col("_md") / (typical + 1e-12))
    return est.select("node", "estimate", var.alias("variance"))


def regrid(src: DataFrame, targets: DataFrame, *, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int, method: str = "bilinear", value: str = "v", by: list[str] | None = None) -> DataFrame:
    """(node, by, value): a regular source grid (i, j, value) at target points (node, lat, lon).

    Corners are found by index arithmetic and fetched by one equi-join. Outside
    the grid, or with a missing corner, the value is null.
    """
    by = by or []
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    y, x = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    inside = y.between(0, n_lat - 1) & x.between(0, n_lon - 1)
    if method == "nearest":
        near = targets.filter(inside).select("node", F.ceil(y - 0.5).alias("i"), F.ceil(x - 0.5).alias("j"), F.lit(1.0).alias("w"))
    else:
        i0, j0 = F.least(F.floor(y), F.lit(n_lat - 2)), F.least(F.floor(x), F.lit(n_lon - 2))
        corner = lambda a, b: F.struct((i0 + a).alias("i"), (j0 + b).alias("j"), ((y - i0 if a else 1 - (y - i0)) * (x - j0 if b else 1 - (x - j0))).alias("w"))
        near = targets.filter(inside).select("node", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("c")).select("node", "c.*")
    full = 1 if method == "nearest" else 4
    got = near.join(src.select(*CELL, *by, clean(F.col(value)).alias("_v")), CELL).groupBy("node", *by).agg(F.sum(F.col("w") * F.col("_v")).alias("_s"), F.count("_v").alias("_c"))
    got = got.select("node", *by, F.when(F.col("_c") == full, F.col("_s")).alias(value))
    return targets.select("node").join(got, "node", "left")


def regrid_conservative(src: DataFrame, *, factor: int, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """Coarser cells of ``factor`` x ``factor``: the mean of the source cells present, weighted by the cosine of latitude if there is one."""
    w = F.cos(F.radians("lat")) if "lat" in src.columns else F.lit(1.0)
    v = clean(F.col(value))
    return src.filter(v.isNotNull()).groupBy(F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j"), *(by or [])).agg((F.sum(w * v) / F.sum(w)).alias(value))


def axis(low: float, high: float, step: float) -> list[float]:
    """Regular axis with its end included."""
    if step <= 0:
        raise ValueError("step must be positive")
    return [low + k * step for k in range(int(np.floor((high - low) / step + 1e-9)) + 1)]


def qa_median(pixels: DataFrame, threshold: float, *, time: str = "t", value: str = "v", qa: str = "qa") -> DataFrame:
    """Daily composite: pixels under the quality threshold drop, the rest give a median."""
    return pixels.filter(F.col(qa) >= threshold).groupBy(*CELL, F.to_date(time).alias("day")).agg(F.median(clean(F.col(value))).alias(value))


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge on the keys; of columns in several frames the first wins where it has a value."""
    out = frames[0]
    for f in frames[1:]:
        both = [c for c in f.columns if c in out.columns and c not in keys]
        out = out.join(f.select(*keys, *(F.col(c).alias(f"_r_{c}") if c in both else c for c in f.columns if c not in keys)), keys, "full")
        out = out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in both}).drop(*(f"_r_{c}" for c in both)) if both else out
    return out


def dineof(matrix: DataFrame, *, group: str = "variable", k_max: int = 8, max_iter: int = 100, tol: float = 1e-4, cv_share: float = 0.02, seed: int = 42) -> DataFrame:
    """(group, t, c, value, rank): gap reconstruction by truncated SVD, the rank chosen on held-out cells.

    ``matrix``: group, t, c, v with null gaps. One group is one dense matrix
    (times x cells) in one task: split large domains into tiles by ``group``.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="c", values="v", dropna=False)
        x = wide.to_numpy(float)
        gap = ~np.isfinite(x)
        mean = np.where(gap.all(axis=0), 0.0, np.nanmean(np.where(gap.all(axis=0), 0.0, x), axis=0))
        rng = np.random.default_rng(seed)
        there = np.argwhere(~gap)
        held = there[rng.permutation(len(there))[: max(1, min(len(there) // 2, max(20, int(cv_share * len(there)))))]]
        out = gap.copy()
        out[held[:, 0], held[:, 1]] = True

        def rebuilt(gaps: np.ndarray, k: int) -> np.ndarray:
            y, before = np.where(gaps, 0.0, x - mean), None
            for _ in range(max_iter):
                u, s, vt = np.linalg.svd(y, full_matrices=False)
                fit = (u[:, :k] * s[:k]) @ vt[:k]
                y = np.where(gaps, fit, y)
                if before is not None and np.linalg.norm(fit - before) <= tol * max(np.linalg.norm(before), 1e-12):
                    break
                before = fit
            return y + mean

        best, least = 1, np.inf
        for k in range(1, min(k_max, *x.shape) + 1):
            err = float(np.sqrt(np.mean((rebuilt(out, k)[held[:, 0], held[:, 1]] - x[held[:, 0], held[:, 1]]) ** 2)))
            if err < least:
                best, least = k, err
            elif err > 1.5 * least:
                break
        full = np.where(gap, rebuilt(gap, best), x)
        t, c = np.meshgrid(wide.index.to_numpy(), wide.columns.to_numpy(), indexing="ij")
        return pd.DataFrame({group: pdf[group].iloc[0], "t": t.ravel(), "c": c.ravel(), "value": full.ravel(), "gap": gap.ravel(), "rank": best})

    types = {n: matrix.schema[n].dataType.simpleString() for n in (group, "t", "c")}
    return matrix.groupBy(group).applyInPandas(fill, f"{group} {types[group]}, t {types['t']}, c {types['c']}, value double, gap boolean, rank int")


def _spherical(h: np.ndarray, range_km: float, sill: float, nugget: float) -> np.ndarray:
    r = np.minimum(h / range_km, 1.0)
    return np.where(h > 0, nugget + (sill - nugget) * (1.5 * r - 0.5 * r**3), 0.0)


def ordinary_kriging(obs: DataFrame, nodes: DataFrame, *, k: int = 16, range_km: float = 300.0, sill: float = 1.0, nugget: float = 0.0) -> DataFrame:
    """(node, estimate, variance) with a spherical variogram over each node's k nearest observations.

    Neighbours come from ``nearest``; a task solves the small systems of a batch
    of nodes at once.
    """
    o = obs.filter(clean(F.col("v")).isNotNull()).select("id", "lat", "lon", F.col("v").cast("double").alias("v"))
    middle = o.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
    if middle["lat"] is None:
        raise ValueError("no observation")
    near = nearest(_plane(nodes, *middle, "node"), _plane(o, *middle, "id"), k)
    rows = near.join(_plane(o, *middle, "id", "v"), "id").join(_plane(nodes, *middle, "node").withColumnsRenamed({"x": "gx", "y": "gy"}), "node")
    each = rows.groupBy("node").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.sort_array(F.collect_list(F.struct("rn", "x", "y", "v"))).alias("near"))  # k at most
    lists = each.select("node", "gx", "gy", *(F.col(f"near.{c}").alias(c) for c in ("x", "y", "v")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["x"].map(len)):
                x, y, v = (np.array(part[c].tolist(), float).reshape(len(part), n) for c in ("x", "y", "v"))
                m = np.ones((len(part), n + 1, n + 1))
                m[:, :n, :n] = _spherical(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]), range_km, sill, nugget)
                m[:, n, n] = 0.0
                away = np.hypot(x - part["gx"].to_numpy()[:, None], y - part["gy"].to_numpy()[:, None])
                rhs = np.concatenate([_spherical(away, range_km, sill, nugget), np.ones((len(part), 1))], axis=1)
                w = np.einsum("nij,nj->ni", np.linalg.pinv(m, rcond=1e-12, hermitian=True), rhs)  # points that coincide leave the system singular
                yield pd.DataFrame({"node": part["node"].to_numpy(), "estimate": (w[:, :n] * v).sum(axis=1), "variance": np.maximum(0.0, (w * rhs).sum(axis=1))})

    kind = nodes.schema["node"].dataType.simpleString()
    return lists.mapInPandas(solve, f"node {kind}, estimate double, variance double")


def regression_kriging(obs: DataFrame, nodes: DataFrame, columns: list[str], *, k: int = 16, range_km: float = 300.0, sill: float = 1.0, nugget: float = 0.0) -> DataFrame:
    """(node, trend, residual, estimate, variance): a linear trend in the columns, with its residuals kriged.

    ``obs`` and ``nodes`` both hold the columns; rows where one is missing take no
    part, and such nodes come back null.
    """
    whole = lambda df: df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    known = whole(obs.filter(clean(F.col("v")).isNotNull()))
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    n = len(terms)
    sums = known.agg(*(F.sum(terms[a] * terms[b]).alias(f"a{a}_{b}") for a in range(n) for b in range(a + 1)), *(F.sum(terms[a] * F.col("v")).alias(f"b{a}") for a in range(n))).first()
    if sums["a0_0"] is None:
        raise ValueError("no observation")
    m = np.array([[sums[f"a{max(a, b)}_{min(a, b)}"] for b in range(n)] for a in range(n)], float)
    coef, *_ = np.linalg.lstsq(m, np.array([sums[f"b{a}"] for a in range(n)], float), rcond=None)
    trend = F.lit(0.0)
    for c, t in zip(coef, terms, strict=True):
        trend = trend + float(c) * t
    rest = known.select("id", "lat", "lon", (F.col("v") - trend).alias("v"))
    kriged = ordinary_kriging(rest, whole(nodes).select("node", "lat", "lon"), k=k, range_km=range_km, sill=sill, nugget=nugget)
    out = nodes.select("node", trend.alias("trend")).join(kriged.withColumnRenamed("estimate", "residual"), "node", "left")
    return out.select("node", "trend", "residual", (F.col("trend") + F.col("residual")).alias("estimate"), "variance")


def fill_gaps(cube: DataFrame, method: str = "auto", *, value: str = "v", time: str = "t", most: float = 0.4) -> DataFrame:
    """Adds filled and method: gaps by the cell's mean ("mean"), in time ("time"), or by inverse distance in each time step ("idw").

    "auto" takes idw where at most the share ``most`` of all is missing, else the
    cell's mean. ``cube`` needs lat and lon for idw; a step without values, and
    what else is left, gets the cell's mean.
    """
    if method not in ("auto", "mean", "time", "idw"):
        raise ValueError(f"unknown method {method!r}")
    v = clean(F.col(value))
    if method == "auto":
        share = cube.agg(F.avg(v.isNull().cast("int"))).first()[0] or 0.0
        method = "idw" if share <= most and {"lat", "lon"} <= set(cube.columns) else "mean"
    if method == "time":
        return time_fill(cube, value=value, time=time).withColumn("method", F.lit("time"))
    filled = mean_fill(cube, value=value)
    if method == "mean":
        return filled.withColumn("method", F.lit("mean"))
    # Steps are set side by side, farther apart than any two of their cells, so that one search serves all of them.
    middle = cube.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
    rows = _plane(cube.withColumn("_v", v), middle["lat"] or 0.0, middle["lon"] or 0.0, *CELL, time, "_v")
    steps = cube.select(time).distinct()
    steps = steps.withColumn("_k", F.row_number().over(Window.orderBy(time)) - 1)  # a row a step
    placed = rows.join(steps, time).withColumn("x", F.col("x") + F.col("_k") * 60_000.0).withColumn("key", F.struct("_k", *CELL))
    near = nearest(placed.filter("_v IS NULL").select(F.col("key").alias("node"), "x", "y"), placed.filter("_v IS NOT NULL").select(F.col("key").alias("id"), "x", "y"), 8)
    near = near.filter(F.col("node")["_k"] == F.col("id")["_k"]).join(placed.select(F.col("key").alias("id"), "_v"), "id")
    w = 1.0 / (F.col("d") * F.col("d") + 1e-12)
    est = near.groupBy("node").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("_e")).select(F.col("node")["_k"].alias("_k"), *(F.col("node")[c].alias(c) for c in CELL), "_e")
    out = filled.join(est.join(steps, "_k").drop("_k"), [*CELL, time], "left")
    return out.withColumn("filled", F.coalesce(v, "_e", "filled")).withColumn("method", F.lit("idw")).drop("_e")

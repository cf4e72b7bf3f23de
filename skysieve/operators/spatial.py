"""Spatial statistics over cells: weights, Gi*, Local Moran, false-discovery control, clusters, trends, labels.

Cells are rows (id, lat, lon, v), with an optional time bin. Weights are an
edge table made once and joined to every bin. Neighbours are found inside
square buckets of a reach, so cost follows the number of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.constants import EARTH_KM
from skysieve.functions.aqi import clean
from skysieve.functions.physics import haversine_km
from skysieve.operators.nearest import nearest
from skysieve.operators.ranks import cumulative, quantiles
from skysieve.operators.scratch import keep


def _bucketed(cells: DataFrame, reach: float) -> DataFrame:
    """(src, dst, d) of cells in a bucket of side ``reach`` degrees and its neighbours; d in degrees."""
    at = lambda p: cells.select(F.col("id").alias(p), F.col("lat").alias(f"{p}_y"), F.col("lon").alias(f"{p}_x"))
    place = lambda p: (F.floor(F.col(f"{p}_y") / reach).alias("by"), F.floor(F.col(f"{p}_x") / reach).alias("bx"))
    by, bx = place("dst")
    around = F.explode(F.array(*(F.struct((by + a).alias("by"), (bx + b).alias("bx")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    near = at("dst").withColumn("b", around).select("dst", "dst_y", "dst_x", "b.by", "b.bx")
    d = F.sqrt(F.pow(F.col("src_y") - F.col("dst_y"), 2) + F.pow(F.col("src_x") - F.col("dst_x"), 2))
    return at("src").select("*", *place("src")).join(near, ["by", "bx"]).filter("src <> dst").withColumn("d", d)


def knn_weights(cells: DataFrame, k: int = 8, *, reach: float | None = None) -> DataFrame:
    """(src, dst, w): the k nearest cells in degrees (ties by id), each 1/k of the weight.

    The search starts with buckets of ``reach`` degrees and widens them for cells
    that have not k proven neighbours; only with fewer than k + 1 cells in all has
    a cell fewer, which then share the weight.
    """
    at = lambda name: cells.select(F.col("id").alias(name), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    near = nearest(at("node"), at("id"), k, side=reach, others=True)
    return near.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("node"))).select(F.col("node").alias("src"), F.col("id").alias("dst"), "w")


def band_weights(cells: DataFrame, band: float) -> DataFrame:
    """(src, dst, w): all cells within the band, row-standardised."""
    near = _bucketed(cells, band).filter(F.col("d") <= band)
    return near.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("src"))).select("src", "dst", "w")


def normal_tail(z: Column) -> Column:
    """P(Z > z), Zelen and Severo's polynomial (error under 7.5e-8)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def gi_star(cells: DataFrame, weights: DataFrame, *, by: list[str] | None = None, permutations: int = 0, seed: int = 42) -> DataFrame:
    """(by, id, z, p): Getis-Ord Gi* with the cell itself among its neighbours, all 1/(k+1); p one-sided, normal.

    With ``permutations``, p is the share of conditional draws that reach the
    cell's sum (not by bins). A bin with under three values, or without spread,
    has null z.
    """
    if permutations and by:
        raise ValueError("permutations are drawn from one field")
    by = by or []
    rows = cells.withColumn("v", clean(F.col("v"))).filter("v IS NOT NULL").select(*by, "id", "v")
    whole = rows.groupBy(*by).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    edges = weights.select("src", "dst").unionByName(cells.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct())
    sums = edges.join(rows.withColumnRenamed("id", "dst"), "dst").groupBy(*by, "src").agg(F.sum("v").alias("sv"), F.count(F.lit(1)).alias("c"))
    joined = sums.join(whole, by) if by else sums.crossJoin(F.broadcast(whole))
    # Weights 1/c: sum w = 1 and sum w^2 = 1/c.
    spread = F.col("s") * F.sqrt((F.col("n") / F.col("c") - 1) / (F.col("n") - 1))
    z = F.when((F.col("n") >= 3) & (F.col("s") > 0), F.try_divide(F.col("sv") / F.col("c") - F.col("m"), spread))
    out = joined.select(*by, F.col("src").alias("id"), z.alias("z")).join(rows.select(*by, "id"), [*by, "id"], "left_semi")
    if permutations:  # the cell's own value is in every draw, so neighbours decide
        return out.join(permutation_p(cells, weights, permutations=permutations, seed=seed).withColumnRenamed("pseudo_p", "p"), "id", "left")
    return out.withColumn("p", F.when(F.col("z").isNotNull(), normal_tail(F.abs(F.col("z")))))


def local_moran(cells: DataFrame, weights: DataFrame, *, by: list[str] | None = None, permutations: int = 0, seed: int = 42) -> DataFrame:
    """(by, id, i, z, lag, p, quadrant): z times the neighbours' mean z; 1 HH, 2 LH, 3 LL, 4 HL; p two-sided by the lag's normal spread.

    With ``permutations``, p is the share of conditional draws that reach the lag (not by bins).
    """
    if permutations and by:
        raise ValueError("permutations are drawn from one field")
    by = by or []
    rows = cells.withColumn("v", clean(F.col("v"))).filter("v IS NOT NULL").select(*by, "id", "v")
    whole = rows.groupBy(*by).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    z = (rows.join(whole, by) if by else rows.crossJoin(F.broadcast(whole))).withColumn("z", F.try_divide(F.col("v") - F.col("m"), F.when(F.col("s") > 0, F.col("s"))))
    lag = weights.join(z.select(*by, F.col("id").alias("dst"), F.col("z").alias("zn")), "dst").groupBy(*by, F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("zn")) / F.sum("w")).alias("lag"), F.count("zn").alias("c"))
    out = z.join(lag, [*by, "id"], "left")
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), 1).when((F.col("z") <= 0) & (F.col("lag") > 0), 2).when((F.col("z") <= 0) & (F.col("lag") <= 0), 3).when((F.col("z") > 0) & (F.col("lag") <= 0), 4)
    p = F.when(F.col("lag").isNotNull(), F.least(2 * normal_tail(F.abs(F.col("lag")) * F.sqrt(F.col("c").cast("double"))), F.lit(1.0)))
    out = out.select(*by, "id", (F.col("z") * F.col("lag")).alias("i"), "z", "lag", p.alias("p"), quadrant.alias("quadrant"))
    if permutations:
        drawn = permutation_p(cells, weights, permutations=permutations, seed=seed).withColumnRenamed("pseudo_p", "p")
        return out.drop("p").join(drawn, "id", "left").select("id", "i", "z", "lag", "p", "quadrant")
    return out


def permutation_p(cells: DataFrame, weights: DataFrame, *, permutations: int = 199, seed: int = 42) -> DataFrame:
    """(id, pseudo_p): share of random neighbour draws with a mean at least as high (or low) as the cell's own.

    Conditional randomisation: a cell's neighbours are drawn from all other
    values, no value twice in a draw. Values are numbered in the order of their
    ids' digests, and draws are digests of seed, id, turn and place modulo their
    number, so partitioning does not matter. Means are summed in the values'
    order, so equal draws tie exactly.
    """
    rows = cells.withColumn("v", clean(F.col("v"))).filter("v IS NOT NULL").select("id", "v")
    total = rows.count()
    placed = rows.select("v", F.xxhash64("id").alias("h"), "id").withColumn("lot", F.pmod("h", F.lit(-(-total // LOT) or 1)))
    lots = placed.groupBy("lot").agg(F.count(F.lit(1)).alias("c"))
    before = lots.select("lot", (F.sum("c").over(Window.orderBy("lot")) - F.col("c")).alias("before"))
    within = F.row_number().over(Window.partitionBy("lot").orderBy("h", "id", "v")) - 1
    numbered = placed.withColumn("within", within).join(before, "lot").select((F.col("before") + F.col("within")).alias("pick"), "v", "id")
    numbered = keep(numbered, "numbered")

    middle = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda s, v: s + v) / F.count(F.lit(1))
    mean = weights.join(rows.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(middle.alias("m"), F.count(F.lit(1)).alias("c"))
    mean = mean.join(numbered.groupBy("id").agg(F.min("pick").alias("own")), "id")
    turns = mean.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    # Others than the cell's own number; more candidates than needed, as some meet.
    other = lambda place: F.pmod(F.xxhash64(F.lit(seed), "id", "turn", place), F.lit(max(total - 1, 1)))
    picks = F.transform(F.sequence(F.lit(1).cast("long"), 3 * F.col("c") + 8), lambda place: other(place) + (other(place) >= F.col("own")).cast("long"))
    drawn = turns.withColumn("pick", F.explode(F.slice(F.array_distinct(picks), F.lit(1), F.col("c").cast("int")))).join(numbered.select("pick", "v"), "pick")
    means = drawn.groupBy("id", "turn").agg(middle.alias("d"), F.first("m").alias("m"))
    above = means.groupBy("id").agg(F.sum((F.col("d") >= F.col("m")).cast("long")).alias("above"))
    return above.select("id", ((F.least("above", F.lit(permutations) - F.col("above")) + 1) / F.lit(permutations + 1)).alias("pseudo_p"))


#: Values numbered in one group; only the groups' sizes are summed in one place.
LOT = 10_000


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.01, *, by: list[str] | None = None, p: str = "p") -> DataFrame:
    """Adds rejected: p at or below the largest p with p <= rank / m * alpha. Null p is never rejected.

    Ranks come from counts per distinct p, so ties are one row.
    """
    by = by or []
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = cumulative(counts, "_p", "_c", by)
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_m"))
    ranked = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))
    cut = ranked.filter(F.col("_p") <= F.col("upto") / F.col("_m") * alpha).groupBy(*by).agg(F.max("_p").alias("_cut"))
    out = tests.join(cut, by, "left") if by else tests.crossJoin(F.broadcast(cut))
    return out.withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def consensus(cells: DataFrame, weights: DataFrame, *, z_spatial: str = "z_spatial", mean: str = "v", gi_alpha: float = 0.01, lisa_alpha: float = 0.05, z_least: float = 2.0, votes: int = 2, permutations: int = 0) -> DataFrame:
    """(id, gi_vote, lisa_vote, high_vote, votes): cells with at least ``votes`` of a significant hot Gi*, a High-High Moran, and a high anomaly at or above the domain's 95th percentile.

    Gi* and Moran are taken on the field's spatial anomaly, so that a gradient
    over the domain makes no hotspot; only the percentile is of the mean itself.
    """
    shape = cells.withColumn("v", F.col(z_spatial))
    gi = benjamini_hochberg(gi_star(shape, weights, permutations=permutations), gi_alpha).select("id", (F.col("rejected") & (F.col("z") > 0)).alias("gi_vote"))
    lisa = local_moran(shape, weights, permutations=permutations).select("id", (F.coalesce(F.col("p") < lisa_alpha, F.lit(False)) & (F.col("quadrant") == 1)).alias("lisa_vote"))
    edge = quantiles(cells, mean, [0.95])[0]
    high = cells.select("id", F.coalesce((F.col(z_spatial) > z_least) & (clean(F.col(mean)) >= F.lit(edge)), F.lit(False)).alias("high_vote"))
    out = gi.join(lisa, "id").join(high, "id")
    total = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("gi_vote", "lisa_vote", "high_vote")), F.lit(0))
    return out.withColumn("votes", total).filter(F.col("votes") >= votes)


def _propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable; labels move along edges and then to their label's label, each round a table of its own."""
    labels = keep(nodes.select("id", F.col("id").alias("label")), "labels")
    edges = keep(edges, "edges")
    while True:
        near = edges.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("l")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("l").alias("l"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("via"))
        jump = step.join(labels.select(F.col("id").alias("via"), F.col("label").alias("far")), "via").select("id", "old", F.least("via", "far").alias("label"))
        grown = keep(jump, "labels")
        if grown.filter("label <> old").isEmpty():
            return grown.select("id", "label")
        labels = grown.select("id", "label")


def dbscan(points: DataFrame, *, eps_km: float = 25.0, least: int = 5, eps_days: float | None = None) -> DataFrame:
    """(id, cluster): density clusters, -1 for noise; a point counts among its own neighbours. Clusters are named by their smallest core id.

    With ``eps_days``, time (column ``day``) is a third axis scaled so that
    eps_days equals eps_km, in one Euclidean ball. Points meet by buckets of eps.
    """
    deg = math.degrees(eps_km / EARTH_KM)
    base = points.select("id", "lat", "lon", *(["day"] if eps_days else []))
    if eps_days:
        middle = base.agg(F.avg("lat").alias("_l"))
        xyz = base.crossJoin(F.broadcast(middle)).select("id", (F.col("lon") * F.cos(F.radians("_l")) / deg).alias("x"), (F.col("lat") / deg).alias("y"), (F.unix_date(F.to_date("day")) / eps_days).alias("z"))
    else:
        # Longitude buckets widen with latitude; 1/cos of the farthest latitude keeps neighbours adjacent.
        far = base.agg(F.max(F.abs("lat")).alias("_l"))
        xyz = base.crossJoin(F.broadcast(far)).select("id", "lat", "lon", (F.col("lon") * F.cos(F.radians(F.least("_l", F.lit(89.0)))) / deg).alias("x"), (F.col("lat") / deg).alias("y"), F.lit(0.0).alias("z"))
    axes = ["x", "y"] + (["z"] if eps_days else [])
    extra = [] if eps_days else ["lat", "lon"]
    steps = [()]
    for _ in axes:
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    left = xyz.select(F.col("id").alias("src"), *(F.col(a).alias(f"s{a}") for a in (*axes, *extra)), *(F.floor(a).alias(f"b{a}") for a in axes))
    around = F.explode(F.array(*(F.struct(*((F.floor(a) + d).alias(f"b{a}") for a, d in zip(axes, s, strict=True))) for s in steps)))
    right = xyz.withColumn("_b", around).select(F.col("id").alias("dst"), *(F.col(a).alias(f"d{a}") for a in (*axes, *extra)), *(F.col(f"_b.b{a}") for a in axes))
    pairs = left.join(right, [f"b{a}" for a in axes])
    if eps_days:
        near = pairs.filter(sum((F.pow(F.col(f"s{a}") - F.col(f"d{a}"), 2) for a in axes), F.lit(0.0)) <= 1.0)
    else:
        near = pairs.filter(haversine_km(F.col("slat"), F.col("slon"), F.col("dlat"), F.col("dlon")) <= eps_km)
    near = keep(near.select("src", "dst"), "near")
    core = keep(near.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col("src").alias("id")), "core")
    inner = near.join(core.withColumnRenamed("id", "src"), "src").join(core.withColumnRenamed("id", "dst"), "dst")
    named = _propagate(core, inner)
    border = near.join(named.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("edge"))
    out = points.select("id").join(named, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "edge", F.lit(-1)).alias("cluster"))


def ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull in turn; points on a line leave their ends, at most two corners."""
    pts = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list[tuple[float, float]] = []
    for half in (pts, pts[::-1]):
        part: list[tuple[float, float]] = []
        for p in half:
            while len(part) >= 2 and turn(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        out += part[:-1]
    return out or pts


def hull(points: list[tuple[float, float]], buffer: float = 0.05) -> str:
    """WKT of the convex hull (lon lat); under three distinct points, or on a line, a square around their box."""
    corners = ring(points)
    if len(corners) < 3:
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        a, b, c, d = min(xs) - buffer, min(ys) - buffer, max(xs) + buffer, max(ys) + buffer
        corners = [(a, b), (c, b), (c, d), (a, d)]
    return "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*corners, corners[0]]) + "))"


def hotspot_polygons(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n_cells, mean_z, max_z, geometry) of clusters, noise left out.

    Tasks send only the corners of what they hold of a cluster, so a cluster of
    any size is a few rows a task where its hull is made.
    """
    rows = points.join(clusters.filter("cluster <> -1"), "id").select("cluster", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("v").cast("double").alias("v"))
    kind = clusters.schema["cluster"].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("cluster"):
                x, y = zip(*ring(list(zip(part["lon"], part["lat"], strict=True))), strict=True)
                yield pd.DataFrame({"cluster": name, "lat": y, "lon": x})

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "geometry": [hull(list(zip(pdf["lon"], pdf["lat"], strict=True)))]})

    partial = rows.select("cluster", "lat", "lon").na.drop().mapInPandas(corners, f"cluster {kind}, lat double, lon double")
    shapes = partial.groupBy("cluster").applyInPandas(shape, f"cluster {kind}, geometry string")
    told = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("v").alias("mean_z"), F.max("v").alias("max_z"))
    return told.join(shapes, "cluster")


def mann_kendall(x: np.ndarray, alpha: float = 0.05) -> tuple[float | None, float | None, float | None]:
    """(z, p, slope): Mann-Kendall with Hamed and Rao's variance correction over significant autocorrelations of detrended ranks, and Sen's slope."""
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return None, None, None
    i, j = np.triu_indices(n, 1)
    s, slope = int(np.sign(x[j] - x[i]).sum()), float(np.median((x[j] - x[i]) / (j - i)))
    ties = np.unique(x, return_counts=True)[1]
    var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
    rest = x - slope * np.arange(n)
    ranks = np.argsort(np.argsort(rest, kind="stable"), kind="stable").astype(float) + 1
    ranks -= ranks.mean()
    total = (ranks**2).sum()
    acf = np.array([(ranks[k:] * ranks[: n - k]).sum() / total for k in range(1, n)])
    bound = normal_quantile(1 - alpha / 2) / math.sqrt(n)
    k = np.arange(1, n)
    keep_ = np.abs(acf) > bound
    factor = 1 + 2 / (n * (n - 1) * (n - 2)) * ((n - k) * (n - k - 1) * (n - k - 2) * acf)[keep_].sum()
    var *= factor if factor > 0 else 1.0
    z = 0.0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    return z, math.erfc(abs(z) / math.sqrt(2)), slope


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by bisection."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def trends(cells: DataFrame, *, value: str = "v", time: str = "t", alpha: float = 0.05) -> DataFrame:
    """(id, n, trend_z, trend_p, sen_slope) of each cell's series, which travel as one array a cell."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [mann_kendall(np.array(a, float), alpha) for a in pdf["a"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(a) for a in pdf["a"]], **{c: pd.Series([m[k] for m in made], index=pdf.index, dtype=float) for k, c in enumerate(("trend_z", "trend_p", "sen_slope"))}})

    kind = cells.schema["id"].dataType.simpleString()
    v = clean(F.col(value)).cast("double")
    dated = F.struct(F.col(time).alias("t"), v.alias("v"))
    series = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.when(v.isNotNull(), dated))).alias("a")).select("id", F.col("a.v").alias("a"))
    return series.mapInPandas(fit, f"id {kind}, n long, trend_z double, trend_p double, sen_slope double").replace(float("nan"), None, ["trend_z", "trend_p", "sen_slope"])


def sen_slope(cells: DataFrame, *, value: str = "v", time: str = "t") -> DataFrame:
    """(id, s, sen_slope): the plain Mann-Kendall sum and Sen's slope, JVM-side, from each series as one sorted array."""
    series = cells.filter(clean(F.col(value)).isNotNull()).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), clean(F.col(value)).alias("v")))).alias("a"))
    pairs = series.select("id", F.posexplode("a").alias("k", "x"), "a").select("id", "x", F.explode(F.slice("a", F.col("k") + 2, F.size("a"))).alias("y"))
    return pairs.groupBy("id").agg(F.sum(F.signum(F.col("y.v") - F.col("x.v"))).cast("long").alias("s"), F.median((F.col("y.v") - F.col("x.v")) / (F.col("y.t") - F.col("x.t"))).alias("sen_slope"))


def label_history(hot: Column, trend_p: Column, trend: Column, alpha: float = 0.05) -> Column:
    """The pattern of an ordered array of hot flags with its trend; the order of the rules is their meaning."""
    n = F.size(hot)
    total = F.size(F.filter(hot, lambda h: h))
    share = F.when(n > 0, total / n)
    now = F.when(n > 0, F.element_at(hot, -1)).otherwise(F.lit(False))
    run = F.coalesce(F.array_position(F.reverse(hot), F.lit(False)) - 1, F.lit(0))
    run = F.when(F.array_contains(hot, F.lit(False)), run).otherwise(n)
    clear = F.coalesce(trend_p < alpha, F.lit(False))
    up, down = clear & (trend > 0), clear & (trend < 0)
    return (
        F.when((n == 0) | (total == 0), "no_pattern").when((share >= 0.9) & ~(up | down), "persistent").when(now & (share >= 0.5) & up, "intensifying")
        .when((share >= 0.5) & down, "diminishing").when(~now & (share >= 0.5), "historical").when(now & (run == 1) & (total == 1), "new")
        .when(now & (run == total) & (run >= 2) & (share < 0.5), "consecutive").when(now & down, "oscillating").otherwise("sporadic")
    )


def emerging_hotspots(cells: DataFrame, weights: DataFrame, *, time: str = "t", gi_alpha: float = 0.01, trend_alpha: float = 0.05) -> DataFrame:
    """(id, n_bins, n_hot, trend_p, sen_slope, label): Gi* in every bin by one join, then each cell's history and trend of z."""
    bins = keep(benjamini_hochberg(gi_star(cells.withColumnRenamed(time, "t"), weights, by=["t"]), gi_alpha, by=["t"]), "bins")
    flags = bins.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", (F.col("rejected") & (F.col("z") > 0)).alias("h")))), lambda x: x["h"]).alias("hot"))
    out = flags.join(trends(bins, value="z", alpha=trend_alpha), "id", "left")
    label = label_history(F.col("hot"), F.col("trend_p"), F.col("sen_slope"), trend_alpha)
    return out.select("id", F.size("hot").alias("n_bins"), F.size(F.filter("hot", lambda h: h)).alias("n_hot"), "trend_p", "sen_slope", label.alias("label"))

"""Domain operators against small hand-made cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.functions import physics
from skysieve.operators import features, fires, grids, metrics, models, ranks, spatial, stations, transport
from skysieve.operators.nearest import nearest
from skysieve.sources import readers, synthetic


def test_physics(spark):
    c = F.lit
    row = spark.range(1).select(
        physics.growth(c(0.0)).alias("a"), physics.growth(c(101.0)).alias("b"), physics.fnr(c(2e-5), c(1e-9)).alias("c"), physics.wind_dir(c(1.0), c(0.0)).alias("d"),
        physics.wind_dir(c(0.0), c(0.0)).alias("e"), physics.compass(c(350.0)).alias("f"), physics.relative_humidity(c(300.0), c(300.0)).alias("g"), physics.season_of(c(dt.date(2024, 10, 1))).alias("h"),
        physics.cell_parent(physics.cell_id(c(10.0), c(70.0), 7), 5).alias("i"), physics.cell_id(*physics.cell_center(physics.cell_id(c(10.0), c(70.0), 7)), 5).alias("j"), physics.pm25_from_species(c(None), c(1e-9), c(None), c(None), c(None)).alias("k"),
    ).first()
    assert row.a == 1.0 and row.b is None and row.c is None and row.d == 270.0 and row.e == 180.0 and row.f == "N"
    assert math.isclose(row.g, 100.0) and row.h == "post_monsoon" and row.i == row.j and math.isclose(row.k, 1.6)


def test_hexagonal_cells(spark):
    rng = np.random.default_rng(12)
    places = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-60, 60, 400), rng.uniform(-170, 170, 400), strict=True)] + [(None, 1.0), (float("nan"), 1.0)], "lat double, lon double")
    cell = physics.cell_id(F.col("lat"), F.col("lon"), 6)
    rows = places.select(cell.alias("c")).select("c", physics.cell_id(*physics.cell_center(F.col("c")), 6).alias("back"), physics.cell_disk(F.col("c"), 2).alias("disk"), physics.cell_resolution(F.col("c")).alias("res"))
    got = rows.collect()
    known = [r for r in got if r.c is not None]
    assert len(known) == 400 and all(r.back == r.c and r.res == 6 and len(set(r.disk)) == 19 == physics.disk_size(2) and r.c in r.disk for r in known)
    apart = rows.filter("c IS NOT NULL").select("c", F.explode("disk").alias("d")).select(physics.cell_distance(F.col("c"), F.col("d")).alias("n"), F.radians(physics.cell_center(F.col("d"))[1]).alias("x")).groupBy("n").count()
    assert {r.n: r["count"] for r in apart.collect()} == {0: 400, 1: 2400, 2: 4800}
    # Cells of a resolution hold equal parts of the sphere, a seventh of the coarser's.
    many = spark.range(200_000).select((F.asin(0.2 + 0.2 * F.rand(1)) * 180 / math.pi).alias("lat"), (70 + 20 * F.rand(2)).alias("lon"))
    counts = [many.select(physics.cell_id(F.col("lat"), F.col("lon"), k).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0] for k in (2, 3)]
    assert 5 < counts[0] / counts[1] < 8.5


def test_rolling_maximum_keeps_missing_hours(spark):
    hours = [h for h in range(24) if h not in (8, 9)]
    rows = [("s", dt.datetime(2024, 1, 1, h), "co", 50.0 if 2 <= h <= 7 else 1.0) for h in hours]
    got = stations.rolling_max(spark.createDataFrame(rows, "station string, ts timestamp, pollutant string, value double")).first()
    assert got.rolling_max == 50.0


def test_hourly_to_daily(spark):
    rows = [("s", dt.datetime(2024, 1, 1, h), p, v) for h in range(24) for p, v in (("co", float(h)), ("pm25", 100.0))]
    rows += [("s", dt.datetime(2024, 1, 2, h), "pm25", 100.0) for h in range(5)]
    got = {r.day.day: r for r in stations.hourly_to_daily(spark.createDataFrame(rows, "station string, ts timestamp, pollutant string, value double"), ("pm25", "co")).collect()}
    assert got[1].co == 19.5 and got[1].pm25 == 100.0 and got[2].pm25 is None


def test_dedup_drops_mirror(spark):
    a = spark.createDataFrame([("A", 28.60, 77.20), ("B", 19.0, 73.0)], "station string, lat double, lon double")
    b = spark.createDataFrame([("mirror", 28.6005, 77.2003), ("genuine", 13.0, 80.0)], "station string, lat double, lon double")
    assert sorted(r.station for r in stations.dedup_against(a, b).collect()) == ["A", "B", "genuine"]


def test_station_id_ignores_case(spark):
    row = spark.range(1).select(physics.station_id(F.lit(" Site A"), F.lit(28.6), F.lit(77.2)).alias("a"), physics.station_id(F.lit("site a"), F.lit(28.6), F.lit(77.2)).alias("b")).first()
    assert row.a == row.b and row.a.startswith("CPCB-") and len(row.a) == 13


def test_sequences(spark):
    rows = [("s", k, float(k)) for k in range(9)] + [("short", 1, 1.0)]
    got = features.sequences(spark.createDataFrame(rows, "station string, day int, x double"), ["x"], window=7).collect()
    assert len(got) == 3 and got[0]["values"][0] == [0.0]


def test_episodes_find_planted_burst(spark):
    rows = [(dt.date(2022, 10, 1) + dt.timedelta(days=d), 30.0, 75.0, 10.0) for d in range(60) for _ in range(50 if 30 <= d <= 34 else 1)]
    got = fires.episodes(spark.createDataFrame(rows, "date date, lat double, lon double, frp double"), period=7, sigma=1.0).collect()
    assert any(r.start <= dt.date(2022, 11, 2) <= r.end and r.season == "oct_nov" for r in got)
    with pytest.raises(ValueError):
        fires.episodes(spark.createDataFrame([], "date date, lat double, lon double, frp double"))


def test_lagged_correlation_finds_lag(spark):
    x = np.random.default_rng(1).normal(size=60)
    rows = [(k, float(x[k]), float(x[k - 1]) if k else 0.0) for k in range(60)]
    got = fires.lagged_correlation(spark.createDataFrame(rows, "date int, a double, b double"), "a", "b", max_lag=3).filter("is_peak").first()
    assert got.lag == 1 and got.r > 0.8


def test_f_tail_and_normal():
    assert math.isclose(fires.f_tail(4.9646, 1, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(spatial.normal_quantile(0.975), 1.95996, abs_tol=1e-4)


def test_metrics_of_exact_line(spark):
    rows = [(float(k), 2.0 * k) for k in range(1, 30)] + [(None, 1.0), (float("nan"), 2.0)]
    got = metrics.metrics_table(spark.createDataFrame(rows, "y_true double, y_pred double")).first()
    assert got.n == 29 and math.isclose(got.r, 1.0) and math.isclose(got.slope, 2.0)


def test_conformal_rank_matches_numpy(spark):
    s = np.random.default_rng(2).normal(size=37) ** 2
    q = metrics.conformal_quantile(spark.createDataFrame([(float(x),) for x in s], "score double"), 0.1).first().q
    assert q == np.quantile(s, metrics.conformal_level(37, 0.1), method="higher")
    with pytest.raises(ValueError):
        metrics.conformal_quantile(spark.range(1), 1.5)


def test_benjamini_hochberg(spark):
    rows = [(k, p) for k, p in enumerate([0.001, 0.2, 0.01, 0.8, None])]
    got = {r.id: r.rejected for r in spatial.benjamini_hochberg(spark.createDataFrame(rows, "id int, p double"), 0.05).collect()}
    assert got[0] and got[2] and not got[1] and not got[3] and not got[4]


def test_gi_star_finds_blob(spark):
    cells = [(i * 20 + j, float(i), float(j), math.exp(-((i - 10) ** 2 + (j - 10) ** 2) / 4)) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(cells, "id int, lat double, lon double, v double")
    w = spatial.knn_weights(df, 8, reach=3.0)
    assert spatial.gi_star(df, w).orderBy(F.desc("z"), "id").first().id == 210
    assert spatial.local_moran(df, w).filter("id = 210").first().quadrant == 1


def test_dbscan(spark):
    pts = [(k, 30.0 + 0.1 * k, 76.0) for k in range(5)] + [(9, 12.0, 88.0)]
    got = {r.id: r.cluster for r in spatial.dbscan(spark.createDataFrame(pts, "id int, lat double, lon double"), eps_km=60.0, least=3).collect()}
    assert {got[k] for k in range(5)} == {0} and got[9] == -1


@pytest.mark.parametrize("hot, want", [([0] * 10, "no_pattern"), ([1] * 10, "persistent"), ([0] * 9 + [1], "new"), ([1] * 6 + [0] * 4, "historical"), ([0] * 7 + [1] * 3, "consecutive"), ([1, 0, 0, 1, 0, 0, 0, 0, 0, 0], "sporadic")])
def test_history_labels(spark, hot, want):
    arr = F.array(*(F.lit(bool(h)) for h in hot))
    assert spark.range(1).select(spatial.label_history(arr, F.lit(0.5), F.lit(0.0)).alias("x")).first().x == want


def test_mann_kendall():
    z, p, slope = spatial.mann_kendall(np.arange(20.0))
    assert z > 3 and p < 0.01 and slope == 1.0
    assert spatial.mann_kendall(np.ones(10)) == (None, None, None)


def test_hull():
    assert spatial.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]).count(",") == 4


def test_quantile_map_recovers_scale(spark):
    rows = [(float(k), 2.0 * k + 1) for k in range(200)]
    df = spark.createDataFrame(rows, "sat double, obs double")
    got = grids.apply_quantile_map(spark.createDataFrame([(50.0,), (300.0,), (None,)], "sat double"), grids.fit_quantile_map(df)).collect()
    assert math.isclose(got[0].mapped, 101.0, abs_tol=1e-6) and math.isclose(got[1].mapped, 601.0, abs_tol=1e-6) and got[2].mapped is None


def test_nearest_against_brute_force(spark):
    """Far nodes, ties, crowds and fewer points than asked for."""
    rng = np.random.default_rng(6)
    pts = np.r_[rng.normal(0, 1, (150, 2)), rng.normal(40, 0.1, (100, 2)), np.repeat([[7.0, 7.0]], 5, axis=0)]
    nodes = np.r_[rng.normal(0, 3, (30, 2)), [[500.0, -300.0], [40.0, 40.0], [7.0, 7.0]]]
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "id int, x double, y double")
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(nodes)], "node int, x double, y double")
    for k in (1, 8):
        want = {(a, int(i), r + 1) for a, (x, y) in enumerate(nodes) for r, i in enumerate(np.lexsort((np.arange(len(pts)), np.hypot(pts[:, 0] - x, pts[:, 1] - y)))[:k])}
        assert {(r.node, r.id, r.rn) for r in nearest(n, p, k).collect()} == want
    few = nearest(n, p.filter("id < 3"), 8)
    assert few.count() == 3 * len(nodes) and nearest(n, p.limit(0), 8).count() == 0 and nearest(n.limit(0), p, 8).count() == 0
    own = nearest(p.withColumnRenamed("id", "node"), p, 2, others=True)
    assert own.filter("node = id").count() == 0 and own.count() == 2 * len(pts)


def test_ranks_hold_no_column_in_one_task(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=999), 2)
    df = spark.createDataFrame([(float(v), int(k % 3)) for k, v in enumerate(x)] + [(None, 0), (float("nan"), 1)], "v double, g int").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.937, 1.0]
    for way in (ranks.quantiles, ranks._by_range):
        assert np.allclose(way(df, "v", probs), np.quantile(x, probs)) and way(df.limit(0), "v", [0.5]) == [None]
    counts = df.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    for r in ranks.cumulative(counts, "v", "c", ["g"]).collect():
        assert r.upto == int((x[np.arange(999) % 3 == r.g] <= r.v).sum())


def test_kriging_and_its_trend(spark):
    rng = np.random.default_rng(5)
    place = rng.uniform(10, 12, (60, 2))
    rows = [(k, float(a), float(b), float(3 * a + b), float(a)) for k, (a, b) in enumerate(place)]
    obs = spark.createDataFrame(rows, "id int, lat double, lon double, v double, h double")
    at = spark.createDataFrame([(k, float(a), float(b), float(a)) for k, (a, b) in enumerate(place[:5])] + [(9, 11.0, 11.0, None)], "node int, lat double, lon double, h double")
    got = {r.node: r for r in grids.ordinary_kriging(obs, at).collect()}
    assert all(abs(got[k].estimate - rows[k][3]) < 1e-6 and got[k].variance < 1e-6 for k in range(5)) and abs(got[9].estimate - 44) < 0.5
    both = {r.node: r for r in grids.regression_kriging(obs, at, ["h"]).collect()}
    assert all(abs(both[k].estimate - rows[k][3]) < 1e-6 for k in range(5)) and both[9].estimate is None


def test_fill_gaps(spark):
    rows = [(i, j, t, 10.0 + i, 70.0 + j, None if (i, j, t) in ((1, 1, 0), (2, 2, 1)) else float(i + j + 10 * t)) for i in range(4) for j in range(4) for t in range(2)]
    cube = spark.createDataFrame(rows, "i int, j int, t int, lat double, lon double, v double")
    got = {(r.i, r.j, r.t): r for r in grids.fill_gaps(cube).collect()}
    assert len(got) == 32 and {r.method for r in got.values()} == {"idw"}
    assert abs(got[1, 1, 0].filled - 2) < 0.3 and abs(got[2, 2, 1].filled - 14) < 0.3 and got[0, 0, 1].filled == 10
    assert {r.filled for r in grids.fill_gaps(cube, "mean").filter("i = 1 AND j = 1").collect()} == {12.0}
    with pytest.raises(ValueError):
        grids.fill_gaps(cube, "magic")


def test_cross_conformal_calibrates_on_other_folds(spark):
    oof = spark.createDataFrame([(k % 2, k, 0.0, 1.0 if k % 2 else 5.0) for k in range(100)], "fold int, id int, y double, prediction double")
    got = models.cross_conformal(oof, label="y").collect()
    assert len(got) == 100 and {(r.fold, r.upper - r.prediction) for r in got} == {(0, 1.0), (1, 5.0)}
    q = spark.createDataFrame([(k, float(k), 2.0, 6.0) for k in range(10)], "id int, y double, q05 double, q95 double")
    wide = models.conformal_quantiles(q, q, label="y").first()
    assert wide.lower == 0.0 and wide.upper == 9.0


def test_polygons_from_partial_hulls(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(b), float(k)) for k, (a, b) in enumerate(rng.uniform(0, 1, (300, 2)))] + [(900, 5.0, 5.0, None), (901, 6.0, 6.0, 1.0), (902, 7.0, 7.0, 2.0)]
    points = spark.createDataFrame(rows, "id int, lat double, lon double, v double").repartition(5)
    clusters = spark.createDataFrame([(k, -1 if k == 299 else 0) for k in range(300)] + [(900, 1), (901, 1), (902, 1)], "id int, cluster int")
    got = {r.cluster: r for r in spatial.hotspot_polygons(points, clusters).collect()}
    corners = spatial.ring([(b, a) for _, a, b, _ in rows[:299]])
    assert set(got) == {0, 1} and got[0].n_cells == 299 and got[0].max_z == 298.0
    assert {tuple(map(float, p.split())) for p in got[0].geometry[10:-2].split(", ")} == set(corners)
    assert got[1].mean_z == 1.5 and got[1].geometry.count(",") == 4  # on a line: a square


def test_trends_skip_missing_steps(spark):
    rows = [("up", t, float(t)) for t in range(12)] + [("gap", t, None if t % 2 else float("nan")) for t in range(6)] + [("flat", t, 1.0) for t in range(6)]
    got = {r.id: r for r in spatial.trends(spark.createDataFrame(rows, "id string, t int, v double")).collect()}
    assert got["up"].n == 12 and got["up"].sen_slope == 1.0 and got["up"].trend_p < 0.05
    assert got["gap"].n == 0 and got["gap"].trend_p is None and got["flat"].n == 6 and got["flat"].trend_z is None


def test_outer_merge_and_sequences_with_missing_values(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 6.0)], "k int, x double, y double")
    b = spark.createDataFrame([(2, 2.0), (3, 3.0), (None, 4.0)], "k int, x double")
    got = sorted(((r.k, r.x, r.y) for r in grids.outer_merge([a, b], ["k"]).collect()), key=str)
    assert got == sorted([(1, 1.0, 5.0), (2, 2.0, 6.0), (3, 3.0, None), (None, 4.0, None)], key=str)
    rows = [("s", dt.date(2024, 1, k + 1), None if k == 2 else float(k)) for k in range(5)] + [("t", dt.date(2024, 1, 1), 1.0)]
    seq = features.sequences(spark.createDataFrame(rows, "station string, day date, v double"), ["v"], window=3).collect()
    assert len(seq) == 3 and {r.station for r in seq} == {"s"} and all(len(r["values"]) == 3 for r in seq)


def test_idw_exact_hit(spark):
    obs = spark.createDataFrame([(1, 20.0, 75.0, 5.0), (2, 25.0, 80.0, 9.0)], "id int, lat double, lon double, v double")
    got = grids.idw(obs, spark.createDataFrame([(1, 20.0, 75.0)], "node int, lat double, lon double")).first()
    assert math.isclose(got.estimate, 5.0, abs_tol=1e-6)
    with pytest.raises(ValueError):
        grids.idw(obs.filter("id > 5"), obs.select(F.col("id").alias("node"), "lat", "lon"))


def test_idw_any_order_of_rows(spark):
    """Places that mirror each other around a node: the same one is nearer in any order of the rows."""
    nodes = [(n, 8.0 + 1.4 * (n % 20), 70.0 + 1.3 * (n // 20)) for n in range(400)]
    obs = [(2 * n + k, lat, lon + (-1) ** k * 0.03, float(2 * n + k)) for n, lat, lon in nodes for k in (0, 1)]
    at = spark.createDataFrame(nodes, "node int, lat double, lon double")
    found = []
    for rows in (obs, obs[::-1], obs[1::2] + obs[::2]):
        got = grids.idw(spark.createDataFrame(rows, "id int, lat double, lon double, v double").coalesce(1), at, k=1).collect()
        found.append({r.node: round(r.estimate) for r in got})
    assert found[0] == found[1] == found[2] and all(found[0][n] // 2 == n for n in range(400))


def test_dineof_fills_low_rank(spark):
    t, c = np.arange(30), np.arange(12)
    field = np.outer(np.sin(t / 3), np.cos(c)) + 2
    rng = np.random.default_rng(3)
    rows = [("v", int(a), int(b), None if rng.random() < 0.2 else float(field[a, b])) for a in t for b in c]
    got = grids.dineof(spark.createDataFrame(rows, "variable string, t int, c int, v double"), k_max=3).toPandas()
    err = [abs(r.value - field[r.t, r.c]) for r in got.itertuples()]
    assert np.mean(err) < 0.05 and not got.value.isna().any()


def test_kriging_is_exact_at_observations(spark):
    obs = spark.createDataFrame([(k, 20.0 + k, 75.0 + k % 3, float(k)) for k in range(6)], "id int, lat double, lon double, v double")
    got = grids.ordinary_kriging(obs, spark.createDataFrame([(1, 22.0, 77.0)], "node int, lat double, lon double")).first()
    assert math.isclose(got.estimate, 2.0, abs_tol=1e-6)


def test_uniform_wind_trajectory(spark):
    wind = spark.createDataFrame([(dt.datetime(2024, 1, 1 + d), float(la), float(lo), 5.0, 0.0) for d in range(3) for la in range(20, 36) for lo in range(70, 86)], "time timestamp, lat double, lon double, u double, v double")
    rel = spark.createDataFrame([(1, dt.datetime(2024, 1, 3), 28.0, 80.0)], "release_id int, time timestamp, lat double, lon double")
    path = transport.back_trajectories(wind, rel, hours=24).orderBy("step").collect()
    assert len(path) == 25 and path[-1].lon < 80 and math.isclose(path[-1].lat, 28.0, abs_tol=1e-6)
    with pytest.raises(ValueError):
        transport.back_trajectories(wind.filter("u > 9"), rel)


def test_folds_are_disjoint(spark):
    rows = spark.range(200).select("id", (F.col("id") % 8).alias("station"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"), (F.col("id") % 8 + 10.0).alias("lat"), (F.col("id") % 5 + 70.0).alias("lon"))
    for scheme in ("random", "leave_station_out", "leave_time_out", "forward_chaining", "spatial_block", "spatiotemporal"):
        split = models.folds(scheme, rows)
        assert split.groupBy("fold", "id").count().filter("count > 1").isEmpty(), scheme
        assert not split.filter("role = 'test'").isEmpty()
    held = models.folds("leave_station_out", rows).join(rows.select("id", "station"), "id").groupBy("fold", "station").agg(F.countDistinct("role").alias("r"))
    assert held.filter("r > 1").isEmpty()
    with pytest.raises(ValueError):
        models.folds("nope", rows)


def test_linear_model_learns(spark):
    rows = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 3 * F.col("a") + F.col("b") + 1)
    model = models.fit(rows, ["a", "b"], "y", "linear", alpha=0.0)
    assert models.predict(model, rows, ["a", "b"]).filter("abs(prediction - y) > 0.01").isEmpty()
    with pytest.raises(ValueError):
        models.fit(rows.limit(1), ["a"], "y")


def test_synthetic_is_deterministic(spark):
    one = synthetic.grid(spark, "2023-10-01", 2, step=4.0)
    two = synthetic.grid(spark, "2023-10-01", 2, step=4.0).repartition(7)
    assert one.exceptAll(two).isEmpty() and one.filter("aod IS NULL").count() > 0


def test_readers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n30.5,75.5,1,1,1,2023-10-05,1,N,V,n,2,1,12.5,D\nbad,75,1,1,1,2023-10-05,1,N,V,n,2,1,x,D\n")
    got = readers.read_fires(spark, str(tmp_path / "f.csv")).collect()
    assert len(got) == 1 and got[0].frp == 12.5 and got[0].sensor == "VIIRS-SNPP"
    (tmp_path / "a.txt").write_text("preamble\nmore, text\nDate(dd:mm:yyyy),AOD_675nm,AOD_440nm\n01:02:2024,0.2,0.4\n01:02:2024,0.2,0.4\n02:02:2024,-999,0.4\n")
    sun = readers.read_sun_photometer(spark, str(tmp_path / "a.txt"), "Site").collect()
    assert len(sun) == 1 and 0.2 < sun[0].aod_550 < 0.4
    readers.write_geo_lines(spark.createDataFrame([(1, 10.0, 70.0)], "id int, lat double, lon double"), str(tmp_path / "g"))
    assert readers.read_geo_lines(spark, str(tmp_path / "g"), "id: int").first().lat == 10.0


def test_permutations_draw_from_the_whole_field(spark):
    """High values in the last cells by digest are drawn as often as others."""
    ids = spark.range(12_000).withColumn("h", F.xxhash64("id")).orderBy("h").select("id").collect()
    cells = spark.createDataFrame([(r.id, float(k >= 10_000)) for k, r in enumerate(ids)], "id long, v double")
    low, high = ids[0].id, ids[-1].id
    weights = spark.createDataFrame([(k, dst) for k in range(40) for dst in (low, high)], "src long, dst long")
    got = {r.id: r.pseudo_p for r in spatial.permutation_p(cells, weights, permutations=99).collect()}
    assert len(got) == 40 and abs(sum(got.values()) / 40 - (1 - (5 / 6) ** 2)) < 0.04
    again = {r.id: r.pseudo_p for r in spatial.permutation_p(cells.repartition(7), weights.repartition(3), permutations=99).collect()}
    assert again == got

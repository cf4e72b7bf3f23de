"""Queries of cross-validation splits, models, transport and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.operators import features, fires, grids, models, spatial, transport
from skysieve.operators.scratch import keep
from skysieve.plans import objectives
from skysieve.plans import views as V
from skysieve.plans.queries import _fill_inputs
from skysieve.plans.views import FIVE, R4, r4
from skysieve.sources import readers, synthetic
from skysieve.streaming import aqi as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_P = "st AS (SELECT DISTINCT user_id AS station, 8.0 + (user_id * 37 % 2800) / 100.0 AS lat, 70.0 + (user_id * 61 % 2600) / 100.0 AS lon FROM events), p AS (SELECT event_id AS id, user_id % 50 AS station, CAST(ts AS DATE) AS day, 8.0 + (user_id * 37 % 2800) / 100.0 AS lat, 70.0 + (user_id * 61 % 2600) / 100.0 AS lon, value FROM events)"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("station"), F.to_date("ts").alias("day"), (F.lit(8.0) + (F.col("user_id") * 37 % 2800) / 100.0).alias("lat"), (F.lit(70.0) + (F.col("user_id") * 61 % 2600) / 100.0).alias("lon"), "value")


_ROWS = " SELECT fold, id, role FROM r"


@query(f"WITH {_P}, f AS (SELECT id, CAST(CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS own FROM p), r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN k = own THEN 'test' ELSE 'train' END AS role FROM f, (SELECT unnest(range(5)) AS k))" + _ROWS)
def cv_random(spark: SparkSession, d: str) -> DataFrame:
    return models.random_folds(_panel(spark, d))


@query(f"WITH {_P}, g AS (SELECT station, CAST((row_number() OVER (ORDER BY md5('42:' || station), station) - 1) % 4 AS INTEGER) AS own FROM (SELECT DISTINCT station FROM p)), r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN k = own THEN 'test' ELSE 'train' END AS role FROM p JOIN g USING (station), (SELECT unnest(range(4)) AS k))" + _ROWS)
def cv_leave_station_out(spark: SparkSession, d: str) -> DataFrame:
    return models.station_folds(_panel(spark, d), 4)


_DAYS = lambda n: f"g AS (SELECT day, CAST(ntile({n}) OVER (ORDER BY day) - 1 AS INTEGER) AS own FROM (SELECT DISTINCT day FROM p))"


@query(f"WITH {_P}, {_DAYS(5)}, r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN k = own THEN 'test' ELSE 'train' END AS role FROM p JOIN g USING (day), (SELECT unnest(range(5)) AS k))" + _ROWS)
def cv_time_blocks(spark: SparkSession, d: str) -> DataFrame:
    return models.time_folds(_panel(spark, d), 5)


@query(f"WITH {_P}, {_DAYS(5)}, r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN own = k + 1 THEN 'test' ELSE 'train' END AS role FROM p JOIN g USING (day), (SELECT unnest(range(4)) AS k) WHERE own <= k + 1)" + _ROWS)
def cv_forward_chaining(spark: SparkSession, d: str) -> DataFrame:
    return models.forward_folds(_panel(spark, d), 4)


_BLOCK = "b AS (SELECT p.*, CAST(floor((lat - (SELECT min(lat) FROM p)) / 4.0) AS BIGINT) || ':' || CAST(floor((lon - (SELECT min(lon) FROM p)) / 4.0) AS BIGINT) AS block FROM p)"


@query(f"""WITH {_P}, {_BLOCK}, g AS (SELECT block, CAST((row_number() OVER (ORDER BY md5('42:' || block), block) - 1) % 4 AS INTEGER) AS own FROM (SELECT DISTINCT block FROM b)), o AS (SELECT b.*, own FROM b JOIN g USING (block)), pl AS (SELECT DISTINCT lat, lon, own FROM o),
near AS (SELECT DISTINCT a.lat, a.lon, t.own AS fold FROM pl a JOIN pl t ON a.own <> t.own AND greatest(abs(a.lat - t.lat), abs(a.lon - t.lon)) < 0.5),
r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN k = own THEN 'test' ELSE 'train' END AS role FROM o, (SELECT unnest(range(4)) AS k) WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.lat = o.lat AND near.lon = o.lon AND near.fold = k AND k <> own))""" + _ROWS)
def cv_spatial_blocks_buffer(spark: SparkSession, d: str) -> DataFrame:
    return models.spatial_folds(_panel(spark, d), block_deg=4.0, buffer_deg=0.5)


@query(f"""WITH {_P}, {_BLOCK}, t AS (SELECT b.*, CAST(floor(date_diff('day', (SELECT min(day) FROM p), day) / 7) AS BIGINT) AS tb FROM b), g AS (SELECT block, CAST((row_number() OVER (ORDER BY md5('42:' || block), block) - 1) % 3 AS INTEGER) AS sf FROM (SELECT DISTINCT block FROM t)),
h AS (SELECT tb, CAST((row_number() OVER (ORDER BY md5('43:' || tb), tb) - 1) % 3 AS INTEGER) AS tf FROM (SELECT DISTINCT tb FROM t)), o AS (SELECT id, sf, tf FROM t JOIN g USING (block) JOIN h USING (tb)),
r AS (SELECT id, CAST(k AS INTEGER) AS fold, CASE WHEN sf = k // 3 AND tf = k % 3 THEN 'test' ELSE 'train' END AS role FROM o, (SELECT unnest(range(9)) AS k) WHERE (sf = k // 3) = (tf = k % 3))""" + _ROWS)
def cv_spatiotemporal(spark: SparkSession, d: str) -> DataFrame:
    return models.spatiotemporal_folds(_panel(spark, d), block_deg=4.0, block_days=7)


_TRAIN = ["l_quantity", "l_discount", "l_tax"]


def _table(spark: SparkSession, d: str) -> DataFrame:
    line = V.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_TRAIN, F.col("l_extendedprice").alias("y"))
    return line


def _ridge_sql(rows: str, label: str, name: str, where: str = "true") -> tuple[str, str]:
    """Tables of a ridge on standardised columns x0 to x2, and the prediction: the correlations' system with the penalty, over the label's deviation, on its diagonal."""
    of = range(3)
    z = lambda c: f"({c} - m_{c}) / s_{c}"
    means = f"m_{name} AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('x0', 'x1', 'x2', label))} FROM {rows} WHERE {where})"
    cells = [f"avg({z(f'x{a}')} * {z(f'x{b}')}){f' + max(0.01 / s_{label})' if a == b else ''} AS a{a}_{b}" for a in of for b in of] + [f"avg({z(f'x{a}')} * {z(label)}) AS b{a}" for a in of]
    solved = V.solved_sql(f"SELECT {', '.join(cells)} FROM {rows}, m_{name} WHERE {where}", 3, f"w_{name}")
    return f"{means}, {solved}", f"(m_{label} + s_{label} * ({' + '.join(f'c{a} * {z(f'x{a}')}' for a in of)}))"


_LINES = "WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2, CAST(l_extendedprice AS DOUBLE) AS y, l_extendedprice - l_quantity * 1000 AS rest FROM lineitem)"


def _linear_cv_sql() -> str:
    out = [_LINES, "f AS (SELECT *, CAST(CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) % 2 AS INTEGER) AS own FROM t)"]
    for k in (0, 1):
        tables, told = _ridge_sql("f", "y", f"f{k}", f"own <> {k}")
        out += [tables, f"p{k} AS (SELECT {k} AS fold, y, greatest({told}, 0.0) AS p FROM f, m_f{k}, w_f{k} WHERE own = {k})"]
    out.append("o AS (SELECT *, avg(y) OVER (PARTITION BY fold) AS mean FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1))")
    sse = "sum((p - y) * (p - y))"
    told = {
        "r": "corr(y, p)", "r2": f"1 - {sse} / sum((y - mean) * (y - mean))", "rmse": "sqrt(avg((p - y) * (p - y)))", "mae": "avg(abs(p - y))", "mbe": "avg(p - y)", "nmb": "sum(p - y) / sum(y)",
        "nme": "sum(abs(p - y)) / sum(y)", "ioa": f"1 - {sse} / sum((abs(p - mean) + abs(y - mean)) * (abs(p - mean) + abs(y - mean)))",
    }
    out.append("e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {sql} AS x FROM o GROUP BY fold" for n, sql in told.items()) + ")")
    return ", ".join(out) + f" SELECT metric, {R4('avg(x)')} AS mean, {R4('stddev_pop(x)')} AS std FROM e GROUP BY 1"


@query(_linear_cv_sql())
def model_linear_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d)
    told = models.fold_summary(models.cross_validate(rows, _TRAIN, "y", models.random_folds(rows, 2)), "y")
    return told.select("metric", r4(F.col("mean")).alias("mean"), r4(F.col("std")).alias("std"))


@query()
def model_boosted_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals for every row, predicted and calibrated by folds that the row is not in."""
    rows = _table(spark, d)
    oof = models.cross_validate(rows, _TRAIN, "y", models.random_folds(rows, 2), kind="boosted", trees=5, depth=4)
    return models.cross_conformal(oof, label="y").select("id", "prediction", "lower", "upper")


@query()
def model_forest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d)
    return models.tree_quantiles(models.fit(rows, _TRAIN, "y", "forest", trees=8, depth=5), rows, _TRAIN).select("id", "q05", "q50", "q95")


_ALL, _TOLD = _ridge_sql("t", "y", "all")
_BLEND = f"""{_LINES}, {_ALL}, m AS (SELECT id, y, greatest({_TOLD}, 0.0) AS m1, x0 * 1000 AS m2 FROM t, m_all, w_all),
e AS (SELECT k / 20.0 AS w, avg((k / 20.0 * m1 + (1 - k / 20.0) * m2 - y) ** 2) AS err FROM m, (SELECT unnest(range(21)) AS k) GROUP BY 1), best AS (SELECT min_by(w, err) AS w FROM e)"""


@query(f"{_BLEND} SELECT id, floor(greatest(w * m1 + (1 - w) * m2, 0.0) + 0.5) AS blend FROM m, best")
def model_blend(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d)
    two = models.predict(models.fit(rows, _TRAIN, "y", "linear"), rows, _TRAIN, as_name="m1")
    two = two.withColumn("m2", F.col("l_quantity") * 1000)
    weights = models.blend_weights(two, ["m1", "m2"], "y")
    return models.blend(two, ["m1", "m2"], weights).select("id", F.floor(F.col("blend") + 0.5).cast("double").alias("blend"))


_REST, _MISS = _ridge_sql("t", "rest", "rest")


@query(f"{_LINES}, {_REST} SELECT id, floor(x0 * 1000 + {_MISS} + 0.5) AS corrected FROM t, m_rest, w_rest")
def residual_correction(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_TRAIN, (F.col("l_quantity") * 1000).alias("sat"), F.col("l_extendedprice").alias("obs"))
    return models.residual_correction(rows, _TRAIN, kind="linear").select("id", F.floor(F.col("corrected") + 0.5).cast("double").alias("corrected"))


@query()
def dineof_fill(spark: SparkSession, d: str) -> DataFrame:
    g = V.grid(spark, d)
    full = g.select("i", "j").distinct().crossJoin(F.broadcast(g.select("t").distinct())).join(g, ["i", "j", "t"], "left")
    matrix = full.select(F.concat_ws(":", F.floor(F.col("i") / 10).cast("string"), F.floor(F.col("j") / 10).cast("string")).alias("variable"), F.unix_date("t").alias("t"), (F.col("i") * 100 + F.col("j")).alias("c"), "v")
    return grids.dineof(matrix, k_max=3)


@query()
def kriging_fill(spark: SparkSession, d: str) -> DataFrame:
    return grids.ordinary_kriging(*_fill_inputs(spark, d))


@query()
def regression_kriging(spark: SparkSession, d: str) -> DataFrame:
    obs, nodes = _fill_inputs(spark, d)
    height = (F.col("lat") * 3 + F.col("lon")).alias("height")
    return grids.regression_kriging(obs.select("*", height), nodes.select("*", height), ["height"])


@query()
def fire_granger(spark: SparkSession, d: str) -> DataFrame:
    pm = V.obs(spark, d).filter("pollutant = 'pm25'").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("b"))
    return fires.granger(fires.daily_series(V.fires(spark, d)).join(pm, "date"), "frp_sum", "b")


@query()
def ehsa_trends(spark: SparkSession, d: str) -> DataFrame:
    return spatial.trends(V.grid(spark, d).select((F.col("i") * 100 + F.col("j")).alias("id"), F.unix_date("t").alias("t"), "v"))


@query()
def gi_star_permutation(spark: SparkSession, d: str) -> DataFrame:
    cells = V.grid(spark, d).groupBy("i", "j").agg(F.avg("v").alias("v")).select((F.col("i") * 100 + F.col("j")).alias("id"), F.col("i").cast("double").alias("lat"), F.col("j").cast("double").alias("lon"), "v")
    return spatial.permutation_p(cells, spatial.knn_weights(cells, 8, reach=4.0), permutations=99)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths back from every station, in the wind of the line items' grid."""
    line = V.read(spark, d, "lineitem")
    i, j = (F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j")
    cells = line.groupBy(F.date_trunc("month", "l_shipdate").alias("time"), i, j).agg(*(F.avg((F.col(c) - m) * 400).alias(n) for c, m, n in (("l_discount", 0.05, "u"), ("l_tax", 0.04, "v"))))
    wind = cells.select(F.col("time").cast("timestamp").alias("time"), (8.0 + 1.4 * F.col("i")).alias("lat"), (70.0 + 1.3 * F.col("j")).alias("lon"), "u", "v")
    at = F.timestamp_seconds(F.lit(820454400) + F.col("station") % 365 * 86400)  # a day of 1996
    releases = V.stations(spark, d).select(F.col("station").alias("release_id"), at.alias("time"), "lat", "lon")
    return transport.back_trajectories(wind, releases, hours=48)


@query()
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d)


@query()
def trajectory_pathways(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each release day's mean path over all stations (all pairs of paths meet, so days, not stations)."""
    day = (F.split("traj_id", "@")[0].cast("long") % 365).cast("string").alias("traj_id")
    paths = keep(_paths(spark, d).groupBy(day, "step").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "paths")
    return transport.pathways(transport.cluster_paths(paths, 2), transport.resample_paths(paths), (24.0, 78.0))


@query()
def synthetic_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    cube = synthetic.inject_fires(synthetic.grid(spark, "2023-10-01", 12, step=2.0), synthetic.fires(spark, "2023-10-01", 12), step=2.0)
    reg, labels = synthetic.stations(spark, cube, 20, step=2.0)
    return features.build_feature_matrix(cube, reg, labels, synthetic.fires(spark, "2023-10-01", 12))


@query("SELECT source, count(*) AS n, count(lat) AS with_place FROM (SELECT 'fires' AS source, 8.0 AS lat FROM events WHERE event_type = 'error' UNION ALL SELECT 'obs', NULL FROM events) GROUP BY 1")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    out = readers.union_sources({"fires": V.fires(spark, d), "obs": V.obs(spark, d)})
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("with_place"))


@query(f"WITH {V.obs_sql()}, {V.DAILY_SQL}, k AS (SELECT max(day) AS last FROM daily) SELECT station, day, {R4('pm25')} AS pm25 FROM daily")
def stream_daily_index(spark: SparkSession, d: str) -> DataFrame:
    """The daily product as a stream over the table's folder, run to its end; each day is closed by a row far ahead, as a stream's next day would."""
    import uuid

    from skysieve.operators.scratch import folder

    events = V.read(spark, d, "events")
    root = f"{folder(events)}/stream-{uuid.uuid4().hex[:12]}"
    ahead = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("station"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit("pm25").alias("pollutant"), F.lit(0.0).alias("value"))
    V.obs(spark, d).select("station", "ts", "pollutant", "value").write.parquet(f"{root}/in/batch=0")
    ahead.write.parquet(f"{root}/in/batch=1")
    source = spark.readStream.schema("station LONG, ts TIMESTAMP, pollutant STRING, value DOUBLE, batch INT").option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
    daily = stream.daily_index(source, FIVE).select("station", "day", "pm25")
    stream.to_parquet(daily, f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.schema("station LONG, day DATE, pm25 DOUBLE").parquet(f"{root}/out").filter("station >= 0").select("station", "day", r4(F.col("pm25")).alias("pm25"))


def _world(spark: SparkSession, days: int, step: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    burnt = synthetic.fires(spark, "2023-10-01", days)
    cube = synthetic.inject_fires(synthetic.grid(spark, "2023-10-01", days, step=step), burnt, step=step)
    return cube, burnt, *synthetic.stations(spark, cube, 24, step=step)


@query()
def objective_surface_index(spark: SparkSession, d: str) -> DataFrame:
    cube, burnt, reg, labels = _world(spark, 8, 4.0)
    return objectives.surface_index(cube, reg, labels, burnt, pollutants=("pm25", "pm10", "no2"), trees=5, depth=4).grid


@query()
def objective_hotspots(spark: SparkSession, d: str) -> DataFrame:
    cube, burnt, _, _ = _world(spark, 14, 2.0)
    return objectives.hotspots(cube, burnt, reach=6.0, votes=1).votes

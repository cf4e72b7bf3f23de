"""Registered queries of the domain operators over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.constants import BREAKPOINTS, CATEGORIES, EARTH_KM, EMISSION_FACTORS, HEX_KM2, INDEX_HIGH, INDEX_LOW, INVENTORIES
from skysieve.functions import aqi, physics
from skysieve.operators import features, fires, grids, metrics, spatial, stations, transport
from skysieve.plans import views as V
from skysieve.plans.views import FIVE, R4, r4

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


def _sub_sql(x: str, p: str) -> str:
    e = BREAKPOINTS[p]
    cases = " ".join(
        (f"WHEN {x} <= {e[k + 1]}" if k < 5 else "ELSE") + (" THEN " if k < 5 else " ") + f"({x} - {e[k]}.0) / ({e[k + 1]}.0 - {e[k]}.0) * {INDEX_HIGH[k] - INDEX_LOW[k]}.0 + {INDEX_LOW[k]}.0" for k in range(6)
    )
    return f"CASE WHEN {x} >= 0 THEN least(greatest(CASE {cases} END, 0.0), 500.0) END"


def _band_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN -1 " + " ".join(f"WHEN {x} <= {INDEX_HIGH[k]} THEN {k}" for k in range(5)) + " ELSE 5 END"


_NAMES = "list_value(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"
AQI_SQL = (
    f"WITH {V.obs_sql()}, {V.DAILY_SQL}, sub AS (SELECT station, day, " + ", ".join(f"{_sub_sql(p, p)} AS {p}" for p in FIVE) + " FROM daily), "
    "t AS (SELECT *, greatest(" + ", ".join(FIVE) + ") AS top, " + " + ".join(f"CAST({p} IS NOT NULL AS INTEGER)" for p in FIVE) + " AS n FROM sub), "
    "a AS (SELECT *, CASE WHEN n >= 3 AND (pm25 IS NOT NULL OR pm10 IS NOT NULL) THEN top END AS aqi, CASE WHEN n >= 3 AND (pm25 IS NOT NULL OR pm10 IS NOT NULL) THEN CASE "
    + " ".join(f"WHEN {p} = top THEN '{p}'" for p in FIVE) + " END END AS responsible FROM t), "
    f"c AS (SELECT *, {_band_sql('aqi')} AS band FROM a) "
)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return stations.pivot_daily(V.obs(spark, d), FIVE)


def _aqi(spark: SparkSession, d: str) -> DataFrame:
    return aqi.compute_aqi(_daily(spark, d))


@query(AQI_SQL + f"SELECT station, day, {R4('aqi')} AS aqi, CASE WHEN band >= 0 THEN {_NAMES}[band + 1] END AS category, responsible FROM c")
def aqi_daily(spark: SparkSession, d: str) -> DataFrame:
    return _aqi(spark, d).select("station", "day", r4(F.col("aqi")).alias("aqi"), F.col("aqi_category").alias("category"), F.col("aqi_responsible").alias("responsible"))


@query(AQI_SQL + "SELECT station, day, p.pollutant, " + R4("p.s") + " AS sub_index FROM c, LATERAL (SELECT unnest(list_value(" + ", ".join(f"struct_pack(pollutant := '{p}', s := {p})" for p in FIVE) + ")) AS p) WHERE p.s IS NOT NULL")
def aqi_subindex_long(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pollutant"), aqi.sub_index(F.col(p), p).alias("s")) for p in FIVE))).alias("x")
    return _daily(spark, d).select("station", "day", each).filter("x.s IS NOT NULL").select("station", "day", "x.pollutant", r4(F.col("x.s")).alias("sub_index"))


@query(AQI_SQL + f"SELECT station, CASE WHEN band >= 0 THEN {_NAMES}[band + 1] ELSE 'none' END AS category, count(*) AS n FROM c GROUP BY 1, 2")
def aqi_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _aqi(spark, d).groupBy("station", F.coalesce("aqi_category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(AQI_SQL + ", w AS (SELECT responsible, count(*) AS n FROM c WHERE aqi IS NOT NULL GROUP BY 1) SELECT responsible, n, " + R4("n / (sum(n) OVER ())::DOUBLE") + " AS share FROM w")
def aqi_responsible_share(spark: SparkSession, d: str) -> DataFrame:
    rows = _aqi(spark, d).filter("aqi IS NOT NULL").groupBy(F.col("aqi_responsible").alias("responsible")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("responsible", "n", r4(F.col("n") / F.col("t")).alias("share"))


@query(AQI_SQL + "SELECT CASE WHEN aqi IS NOT NULL THEN 'valid' WHEN n < 3 THEN 'too few' ELSE 'no particles' END AS reason, count(*) AS n FROM c GROUP BY 1")
def aqi_invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    n = sum((aqi.sub_index(F.col(p), p).isNotNull().cast("int") for p in FIVE), F.lit(0))
    return _aqi(spark, d).groupBy(F.when(F.col("aqi").isNotNull(), "valid").when(n < 3, "too few").otherwise("no particles").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(AQI_SQL + "SELECT station, day, CAST(CASE " + " ".join(f"WHEN responsible = '{p}' THEN {k}" for k, p in enumerate(FIVE[:4])) + " WHEN responsible = 'co' THEN 4 ELSE -1 END AS INTEGER) AS code, CAST(band AS INTEGER) AS band FROM c")
def aqi_grid_codes(spark: SparkSession, d: str) -> DataFrame:
    return aqi.compute_aqi_grid(_daily(spark, d)).select("station", "day", F.col("aqi_responsible").cast("int").alias("code"), F.col("aqi_category").cast("int").alias("band"))


@query(f"WITH {V.obs_sql()}, {V.DAILY_SQL} SELECT station, day, " + ", ".join(f"{R4(p)} AS {p}" for p in FIVE) + " FROM daily")
def obs_pivot_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("station", "day", *(r4(F.col(p)).alias(p) for p in FIVE))


@query(f"WITH {V.obs_sql(2)} SELECT station, CAST(ts AS DATE) AS day, pollutant, count(value) AS n, {R4('count(value) / 24.0')} AS completeness, count(value) / 24.0 >= 0.75 AS complete FROM obs WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def obs_completeness_daily(spark: SparkSession, d: str) -> DataFrame:
    return stations.completeness(V.obs(spark, d, 2)).select("station", "day", "pollutant", "n", r4(F.col("completeness")).alias("completeness"), "complete")


_ROLL_SQL = f"""WITH {V.obs_sql(2)}, h AS (SELECT station, CAST(ts AS DATE) AS day, pollutant, hour(ts) AS hour, avg(value) AS v FROM obs WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
sp AS (SELECT station, day, pollutant, unnest(range(a, b + 1)) AS hour FROM (SELECT station, day, pollutant, min(hour) AS a, max(hour) AS b FROM h GROUP BY 1, 2, 3)),
j AS (SELECT sp.*, h.v FROM sp LEFT JOIN h USING (station, day, pollutant, hour)),
m AS (SELECT *, CASE WHEN count(v) OVER w >= 6 THEN avg(v) OVER w END AS m FROM j WINDOW w AS (PARTITION BY station, day, pollutant ORDER BY hour ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
"""


@query(_ROLL_SQL + f"SELECT station, day, pollutant, {R4('max(m)')} AS rolling_max FROM m GROUP BY 1, 2, 3")
def obs_rolling8h_max(spark: SparkSession, d: str) -> DataFrame:
    return stations.rolling_max(V.obs(spark, d, 2)).withColumn("rolling_max", r4(F.col("rolling_max")))


@query(
    _ROLL_SQL + f""", c AS (SELECT station, CAST(ts AS DATE) AS day, pollutant, count(value) AS n, avg(value) AS mean FROM obs WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT station, day, pollutant, max(m) AS r FROM m GROUP BY 1, 2, 3), x AS (SELECT c.*, CASE WHEN n / 24.0 >= 0.75 THEN CASE WHEN pollutant = 'co' THEN r ELSE mean END END AS v FROM c LEFT JOIN r USING (station, day, pollutant))
SELECT station, day, """ + ", ".join(f"{R4(f'''max(v) FILTER (WHERE pollutant = '{p}')''')} AS {p}" for p in FIVE) + " FROM x GROUP BY 1, 2"
)
def station_hourly_to_daily(spark: SparkSession, d: str) -> DataFrame:
    return stations.hourly_to_daily(V.obs(spark, d, 2), FIVE).select("station", "day", *(r4(F.col(p)).alias(p) for p in FIVE))


@query(f"WITH {V.STATIONS_SQL} SELECT station, 'CPCB-' || upper(substr(sha1(lower(trim(name)) || '|' || CAST(round(CAST(lat AS DOUBLE), 3) AS VARCHAR) || '|' || CAST(round(CAST(lon AS DOUBLE), 3) AS VARCHAR)), 1, 8)) AS station_id FROM st")
def station_id_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.stations(spark, d).select("station", physics.station_id(F.col("name"), F.col("lat"), F.col("lon")).alias("station_id"))


_REGION = "CASE WHEN lat BETWEEN 24 AND 31 AND lon BETWEEN 73 AND 88 THEN 'IGP' WHEN lat <= 15 THEN 'Peninsula' WHEN lon <= 72.5 OR lon >= 90 THEN 'Coastal' ELSE 'Central' END"


@query(f"WITH {V.STATIONS_SQL} SELECT station, {_REGION} AS region FROM st")
def station_region(spark: SparkSession, d: str) -> DataFrame:
    return V.stations(spark, d).select("station", physics.region_of(F.col("lat"), F.col("lon")).alias("region"))


@query(f"""WITH {V.STATIONS_SQL}, p AS (SELECT station, radians(lon) * cos(radians(lat)) * 6371.0 AS x, radians(lat) * 6371.0 AS y FROM st)
SELECT station FROM p WHERE station % 2 = 0 UNION ALL
SELECT station FROM p s WHERE station % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.station % 2 = 0 AND sqrt((q.x - s.x) ** 2 + (q.y - s.y) ** 2) <= 60)""")
def station_dedup_antijoin(spark: SparkSession, d: str) -> DataFrame:
    st = V.stations(spark, d)
    return stations.dedup_against(st.filter("station % 2 = 0"), st.filter("station % 2 = 1"), radius_km=60.0).select("station")


@query(f"""WITH {V.STATIONS_SQL}, r AS (SELECT station, {_REGION} AS region, CASE WHEN station % 7 = 0 THEN 'model' ELSE 'CPCB' END AS source FROM st),
k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sha1('42:' || station), station) AS rn, count(*) OVER (PARTITION BY region) AS n FROM r)
SELECT station, region, CASE WHEN source = 'model' THEN 'gapfill' WHEN rn <= round_even(n * 0.18, 0) THEN 'validation' ELSE 'label' END AS tag FROM k""")
def station_tags(spark: SparkSession, d: str) -> DataFrame:
    st = V.stations(spark, d).withColumns({"region": physics.region_of(F.col("lat"), F.col("lon")), "source": F.when(F.col("station") % 7 == 0, "model").otherwise("CPCB")})
    return stations.tag_stations(st).select("station", "region", "tag")


_NODE = "CAST(least(greatest(ceil((lat - 8.0) / 1.4 - 0.5), 0), 19) AS INTEGER) AS i, CAST(least(greatest(ceil((lon - 70.0) / 1.3 - 0.5), 0), 19) AS INTEGER) AS j"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    st = V.stations(spark, d)
    return st.withColumns({"i": features.axis_index(F.col("lat"), 8.0, 1.4, 20), "j": features.axis_index(F.col("lon"), 70.0, 1.3, 20)})


@query(f"WITH {V.STATIONS_SQL} SELECT station, {_NODE} FROM st")
def station_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("station", "i", "j")


@query(f"WITH {V.obs_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY station, pollutant ORDER BY ts DESC, value DESC) AS rn FROM obs) SELECT station, pollutant, ts, {R4('value')} AS value FROM r WHERE rn = 1")
def latest_per_station(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("x")
    return V.obs(spark, d).groupBy("station", "pollutant").agg(best).select("station", "pollutant", "x.ts", r4(F.col("x.value")).alias("value"))


_SERIES = f"{V.FIRES_SQL}, dd AS (SELECT date, count(*) AS fire_count, sum(frp) AS frp_sum FROM fires GROUP BY 1), sp AS (SELECT CAST(unnest(range(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM dd), s AS (SELECT sp.date, coalesce(fire_count, 0) AS fire_count, coalesce(frp_sum, 0.0) AS frp_sum FROM sp LEFT JOIN dd USING (date))"


@query(f"WITH {_SERIES} SELECT date, fire_count, {R4('frp_sum')} AS frp_sum FROM s")
def fires_daily_dense(spark: SparkSession, d: str) -> DataFrame:
    return fires.daily_series(V.fires(spark, d)).select("date", "fire_count", r4(F.col("frp_sum")).alias("frp_sum"))


_SIDE7 = f"sqrt({2 * HEX_KM2 / (3 * math.sqrt(3) * EARTH_KM**2)!r} / pow(7.0, 7))"
_HEX7 = f"""h AS (SELECT date, frp, ({math.sqrt(3) / 3!r} * radians(lon) - sin(radians(lat)) / 3) / {_SIDE7} AS q, ({2 / 3!r} * sin(radians(lat))) / {_SIDE7} AS r FROM fires), c AS (SELECT date, frp, q, r, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h),
x AS (SELECT date, frp, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS q, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN rr WHEN abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS r FROM c)"""


@query(f"WITH {V.FIRES_SQL}, {_HEX7} SELECT '7:' || CAST(q AS BIGINT) || ':' || CAST(r AS BIGINT) AS cell, date AS day, count(*) AS fire_count, {R4('sum(frp)')} AS fire_frp_sum FROM x GROUP BY 1, 2")
def fires_per_cell(spark: SparkSession, d: str) -> DataFrame:
    return features.fire_counts(V.fires(spark, d)).withColumn("fire_frp_sum", r4(F.col("fire_frp_sum")))


def _coef(s: str) -> str:
    return f"(0.368 * 86400.0 * {EMISSION_FACTORS['crop_residue'][s]} / 1000.0)"


@query(f"WITH {V.FIRES_SQL} SELECT event_id, {R4(f'frp * {_coef('hcho')}')} AS emis_hcho_kg, {R4(f'frp * {_coef('co')}')} AS emis_co_kg FROM fires")
def fires_emissions(spark: SparkSession, d: str) -> DataFrame:
    return fires.emission_rates(V.fires(spark, d), ("hcho", "co")).select("event_id", r4(F.col("emis_hcho_kg")).alias("emis_hcho_kg"), r4(F.col("emis_co_kg")).alias("emis_co_kg"))


_CELL2 = "CAST(least(floor((lat - 8.0) / 2.0), 13) AS BIGINT) AS i, CAST(least(floor((lon - 70.0) / 2.0), 12) AS BIGINT) AS j"


@query(f"WITH {V.FIRES_SQL} SELECT {_CELL2}, {R4(f'sum(frp * {_coef('hcho')} * 1.0)')} AS emission_kg, count(*) AS n FROM fires WHERE lat BETWEEN 8 AND 36 AND lon BETWEEN 70 AND 96 GROUP BY 1, 2")
def fires_inventory_grid(spark: SparkSession, d: str) -> DataFrame:
    return fires.grid_emissions(V.fires(spark, d), box=V.BOX, step=2.0).select("i", "j", r4(F.col("emission_kg")).alias("emission_kg"), "n")


@query(f"WITH {V.FIRES_SQL}, b AS (SELECT sum(frp) * {_coef('hcho')} AS base FROM fires), e AS (SELECT k.inventory, base * k.s AS total_kg FROM b, (VALUES " + ", ".join(f"('{k}', {v})" for k, v in INVENTORIES.items()) + f") AS k(inventory, s)) SELECT inventory, {R4('total_kg')} AS total_kg, {R4('(median(total_kg) OVER ())')} AS central, {R4('min(total_kg) OVER ()')} AS low, {R4('max(total_kg) OVER ()')} AS high, {R4('max(total_kg) OVER () / min(total_kg) OVER ()')} AS spread FROM e")
def fires_inventory_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return fires.inventory_ensemble(V.fires(spark, d)).select("inventory", *(r4(F.col(c)).alias(c) for c in ("total_kg", "central", "low", "high", "spread")))


_DECOMP = _SERIES + """, t AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, sum(frp_sum) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS trend FROM s),
ph AS (SELECT i % 7 AS p, avg(frp_sum - trend) AS raw FROM t GROUP BY 1), c AS (SELECT avg(raw) AS m FROM ph),
dec AS (SELECT date, frp_sum, trend, raw - m AS seasonal, frp_sum - trend - (raw - m) AS residual FROM t JOIN ph ON ph.p = t.i % 7, c)"""


@query(f"WITH {_DECOMP} SELECT date, {R4('trend')} AS trend, {R4('seasonal')} AS seasonal, {R4('residual')} AS residual FROM dec")
def fires_ma_decompose(spark: SparkSession, d: str) -> DataFrame:
    return fires.decompose(fires.daily_series(V.fires(spark, d)), 7).select("date", *(r4(F.col(c)).alias(c) for c in ("trend", "seasonal", "residual")))


@query(f"""WITH {_DECOMP}, z AS (SELECT *, residual / (SELECT stddev_pop(residual) FROM dec) AS z FROM dec), f AS (SELECT *, z > 0.25 AS above, row_number() OVER (ORDER BY date) AS i FROM z),
k AS (SELECT *, i - sum(CAST(above AS INTEGER)) OVER (ORDER BY date) AS g FROM f), e AS (SELECT min(date) AS "start", max(date) AS "end", count(*) AS duration_days, max_by(date, struct_pack(z := z, d := -epoch(date::TIMESTAMP))) AS peak_date,
max_by(frp_sum, struct_pack(z := z, d := -epoch(date::TIMESTAMP))) AS peak, sum(frp_sum) AS total, avg(z) AS zz FROM k WHERE above GROUP BY g HAVING count(*) >= 2)
SELECT "start", "end", duration_days, peak_date, {R4('peak')} AS peak_frp, {R4('total')} AS total_frp, {R4('zz')} AS mean_residual_sigma, CASE WHEN month("start") IN (10, 11) THEN 'oct_nov' WHEN month("start") IN (4, 5) THEN 'apr_may' ELSE 'other' END AS season FROM e""")
def fires_episodes(spark: SparkSession, d: str) -> DataFrame:
    out = fires.episodes(V.fires(spark, d), period=7, sigma=0.25)
    return out.withColumns({c: r4(F.col(c)) for c in ("peak_frp", "total_frp", "mean_residual_sigma")})


_FX = f"{_SERIES}, {V.obs_sql()}, m AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS pm FROM obs WHERE pollutant = 'pm25' GROUP BY 1), x AS (SELECT s.date, frp_sum AS a, pm AS b FROM s JOIN m USING (date))"


def _fire_pairs(spark: SparkSession, d: str) -> DataFrame:
    pm = V.obs(spark, d).filter("pollutant = 'pm25'").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("b"))
    return fires.daily_series(V.fires(spark, d)).join(pm, "date").select("date", F.col("frp_sum").alias("a"), "b")


@query(f"""WITH {_FX}, n AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS c FROM x),
g AS (SELECT i, a, b, unnest(list_filter([i, CASE WHEN i <= 7 THEN 1 - i END, CASE WHEN i > c - 7 THEN 2 * c + 1 - i END], lambda q: q IS NOT NULL)) AS pos FROM n),
w AS (SELECT i, pos, a - avg(a) OVER v AS a, b - avg(b) OVER v AS b FROM g WINDOW v AS (ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)), q AS (SELECT i, a, b FROM w WHERE pos = i),
l AS (SELECT k.lag, p.a, q.b FROM q p, (SELECT unnest(range(-5, 6)) AS lag) k, q WHERE q.i = p.i + k.lag)
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, {R4('corr(a, b)')} AS r FROM l GROUP BY 1""")
def fire_grid_xcorr(spark: SparkSession, d: str) -> DataFrame:
    return fires.lagged_correlation(_fire_pairs(spark, d), "a", "b", max_lag=5).select("lag", "n", r4(F.col("r")).alias("r"))


@query(f"WITH {_FX} SELECT count(*) AS n, {R4('quantile_cont(b, 0.1)')} AS background, {R4('regr_slope(b, a) * 1000')} AS slope, {R4('avg(b) - quantile_cont(b, 0.1) - regr_slope(b, a) * avg(a)')} AS intercept, {R4('corr(a, b)')} AS r FROM x")
def fire_grid_slope(spark: SparkSession, d: str) -> DataFrame:
    out = fires.slope(_fire_pairs(spark, d), "a", "b")
    return out.select("n", r4(F.col("background")).alias("background"), r4(F.col("slope") * 1000).alias("slope"), r4(F.col("intercept")).alias("intercept"), r4(F.col("r")).alias("r"))


_LAGS = f"WITH {V.obs_sql()}, {V.DAILY_SQL}"


@query(_LAGS + f", l AS (SELECT station, day, lag(pm25, 1) OVER w AS a, lag(pm25, 3) OVER w AS b FROM daily WINDOW w AS (PARTITION BY station ORDER BY day)) SELECT station, day, {R4('a')} AS pm25_lag1, {R4('b')} AS pm25_lag3 FROM l")
def feature_lags(spark: SparkSession, d: str) -> DataFrame:
    return features.add_lags(_daily(spark, d), ["pm25"], [1, 3], group="station").select("station", "day", r4(F.col("pm25_lag1")).alias("pm25_lag1"), r4(F.col("pm25_lag3")).alias("pm25_lag3"))


@query(_LAGS + f", l AS (SELECT station, day, CASE WHEN count(pm25) OVER w >= 2 THEN avg(pm25) OVER w END AS a, CASE WHEN count(pm25) OVER w >= 2 THEN max(pm25) OVER w END AS b, CASE WHEN count(pm25) OVER w >= 2 THEN stddev_samp(pm25) OVER w END AS c FROM daily WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT station, day, {R4('a')} AS mean3, {R4('b')} AS max3, {R4('c')} AS std3 FROM l")
def feature_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = features.add_rolling(_daily(spark, d), ["pm25"], [3], group="station", stats=("mean", "max", "std"), least=2)
    return out.select("station", "day", *(r4(F.col(f"pm25_roll3_{s}")).alias(f"{s}3") for s in ("mean", "max", "std")))


@query(_LAGS + f", l AS (SELECT station, day, row_number() OVER o AS rn, list(coalesce(pm25, 0)) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v FROM daily WINDOW o AS (PARTITION BY station ORDER BY day)) SELECT station, day AS \"end\", CAST(len(v) AS BIGINT) AS n, {R4('list_sum(v)')} AS total FROM l WHERE rn >= 7 AND (rn - 7) % 2 = 0")
def feature_sequences(spark: SparkSession, d: str) -> DataFrame:
    out = features.sequences(_daily(spark, d).na.fill(0.0, ["pm25"]), ["pm25"], window=7, stride=2)
    return out.select("station", "end", F.size("values").cast("long").alias("n"), r4(F.aggregate("values", F.lit(0.0), lambda a, x: a + x[0])).alias("total"))


@query(f"WITH {V.obs_sql()}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM obs) SELECT day, {R4('sin(2 * pi() * dayofyear(day) / 365.25)')} AS doy_sin, {R4('cos(2 * pi() * dayofyear(day) / 365.25)')} AS doy_cos, {R4('sin(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_sin, {R4('cos(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_cos, CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(day) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post_monsoon' END AS season FROM d")
def feature_doy_dow(spark: SparkSession, d: str) -> DataFrame:
    days = V.obs(spark, d).select(F.to_date("ts").alias("day")).distinct()
    (a, b), (c, e) = physics.day_of_year_features(F.col("day")), physics.day_of_week_features(F.col("day"))
    return days.select("day", r4(a).alias("doy_sin"), r4(b).alias("doy_cos"), r4(c).alias("dow_sin"), r4(e).alias("dow_cos"), physics.season_of(F.col("day")).alias("season"))


_PHYS = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS aod, l_quantity * 2 AS rh, l_extendedprice / 50 AS blh, l_tax * 1e-6 AS no2, l_discount * 1e-6 AS hcho, 280 + l_quantity / 5 AS t, 275 + l_quantity / 10 AS dew FROM lineitem"


@query(f"""WITH p AS ({_PHYS}) SELECT l_orderkey, l_linenumber, {R4('CASE WHEN rh BETWEEN 0 AND 100 THEN pow(1 - least(rh, 99.0) / 100, -0.6) END')} AS growth,
{R4('CASE WHEN rh BETWEEN 0 AND 100 THEN aod / pow(1 - least(rh, 99.0) / 100, -0.6) END')} AS aod_dry, {R4('CASE WHEN blh > 0 THEN aod / blh * 1000 END')} AS aod_pbl,
{R4('CASE WHEN hcho >= 0 AND no2 >= 1e-8 THEN hcho / no2 END')} AS fnr,
{R4('least(greatest(100 * exp(17.625 * (dew - 273.15) / (243.04 + (dew - 273.15))) / exp(17.625 * (t - 273.15) / (243.04 + (t - 273.15))), 0), 100)')} AS rh_magnus FROM p""")
def feature_physics(spark: SparkSession, d: str) -> DataFrame:
    p = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("aod"), (F.col("l_quantity") * 2).alias("rh"), (F.col("l_extendedprice") / 50).alias("blh"), (F.col("l_tax") * 1e-6).alias("no2"), (F.col("l_discount") * 1e-6).alias("hcho"), (280 + F.col("l_quantity") / 5).alias("t"), (275 + F.col("l_quantity") / 10).alias("dew"))
    c = F.col
    return p.select("l_orderkey", "l_linenumber", r4(physics.growth(c("rh"))).alias("growth"), r4(physics.dry_aod(c("aod"), c("rh"))).alias("aod_dry"), r4(physics.pbl_aod(c("aod"), c("blh")) * 1000).alias("aod_pbl"), r4(physics.fnr(c("hcho"), c("no2"))).alias("fnr"), r4(physics.relative_humidity(c("t"), c("dew"))).alias("rh_magnus"))


@query("""WITH p AS (SELECT l_discount / l_tax AS f FROM lineitem WHERE l_tax > 0 UNION ALL SELECT NULL FROM lineitem WHERE l_tax <= 0)
SELECT CASE WHEN f IS NULL THEN 'unknown' WHEN f < 1 THEN 'VOC-limited' WHEN f > 2 THEN 'NOx-limited' ELSE 'transitional' END AS regime, count(*) AS n FROM p GROUP BY 1""")
def fnr_regime(spark: SparkSession, d: str) -> DataFrame:
    ratio = physics.fnr_map(F.col("l_discount"), F.col("l_tax"))
    return V.read(spark, d, "lineitem").groupBy(physics.fnr_regime(ratio).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT l_returnflag, count(*) AS n, {R4('avg(CAST(abs(l_discount - l_tax) <= 0.05 + 0.15 * l_tax AS INTEGER))')} AS within FROM lineitem GROUP BY 1")
def aod_expected_error(spark: SparkSession, d: str) -> DataFrame:
    ok = physics.within_expected_error(F.col("l_discount"), F.col("l_tax")).cast("int")
    return V.read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(ok)).alias("within"))


@query(f"SELECT l_orderkey, l_linenumber, {R4('CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_discount * pow(550.0 / 440.0, ln(l_discount / l_tax) / ln(440.0 / 675.0)) END')} AS aod_550 FROM lineitem")
def aod_interp_550(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(physics.aod_550(F.col("l_discount"), F.col("l_tax"))).alias("aod_550"))


@query("""SELECT code, CAST(code AS INTEGER) * 0 + count(*) AS n, CAST(max(mee) AS DOUBLE) AS mee FROM (SELECT code, CASE code WHEN 1 THEN 0.7 WHEN 2 THEN 9.0 WHEN 3 THEN 4.5 WHEN 4 THEN 4.5 END AS mee FROM
(SELECT CAST(CASE WHEN i >= 1 AND g <= 0.6 THEN 1 WHEN i >= 1 AND g >= 1.2 THEN 2 WHEN i < 1 AND g >= 1.2 THEN 3 ELSE 4 END AS INTEGER) AS code FROM (SELECT l_discount * 20 AS i, l_tax * 20 AS g FROM lineitem))) GROUP BY 1""")
def aerosol_codes(spark: SparkSession, d: str) -> DataFrame:
    code = physics.aerosol_code(F.col("l_discount") * 20, F.col("l_tax") * 20).cast("int")
    rows = V.read(spark, d, "lineitem").select(code.alias("code"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max(physics.extinction_of_code(F.col("code"))).alias("mee"))


_DIR = "CASE WHEN u = 0 AND v = 0 THEN 180.0 ELSE fmod(degrees(atan2(-u, -v)) + 360.0, 360.0) END"
_COMPASS = "list_value('N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW')"


@query(f"WITH {V.WIND_SQL} SELECT l_orderkey, l_linenumber, {R4('sqrt(u * u + v * v)')} AS speed, {R4(_DIR)} AS direction, {_COMPASS}[CAST(floor(({_DIR}) / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM wind")
def wind_speed_dir(spark: SparkSession, d: str) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    return V.wind(spark, d).select("l_orderkey", "l_linenumber", r4(physics.wind_speed(u, v)).alias("speed"), r4(physics.wind_dir(u, v)).alias("direction"), physics.compass(physics.wind_dir(u, v)).alias("compass"))


_POLAR = f"WITH {V.WIND_SQL}, r AS (SELECT sqrt(u * u + v * v) AS s, {_DIR} AS d, conc FROM wind), q AS (SELECT greatest(quantile_cont(s, 0.99), 1e-6) AS top FROM r), b AS (SELECT CAST(least(greatest(floor(s / (top / 6)), 0), 5) AS BIGINT) AS speed_bin, CAST(least(greatest(floor(d / 22.5), 0), 15) AS BIGINT) AS dir_bin, avg(conc) AS value, count(*) AS n FROM r, q GROUP BY 1, 2)"


@query(_POLAR + f" SELECT speed_bin, dir_bin, {R4('value')} AS value, n FROM b")
def polar_bins(spark: SparkSession, d: str) -> DataFrame:
    return transport.polar_bins(V.wind(spark, d)).withColumn("value", r4(F.col("value")))


@query(_POLAR + f", k AS (SELECT dir_bin, sum(value * n) / sum(n) AS value, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1) SELECT dir_bin, {R4('value')} AS value, n, {_COMPASS}[CAST(floor((dir_bin + 0.5) * 22.5 / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM k ORDER BY k.value DESC, dir_bin LIMIT 1")
def dominant_direction(spark: SparkSession, d: str) -> DataFrame:
    return transport.dominant_direction(transport.polar_bins(V.wind(spark, d))).select("dir_bin", r4(F.col("value")).alias("value"), "n", "compass")


@query(f"WITH {V.WIND_SQL}, r AS (SELECT {_DIR} AS d, conc AS c FROM wind), q AS (SELECT quantile_cont(c, [0.25, 0.5, 0.75]) AS q FROM r) SELECT CAST(least(greatest(floor(d / 22.5), 0), 15) AS BIGINT) AS dir_bin, CAST(len(list_filter(q, lambda x: x <= c)) AS INTEGER) AS quartile, count(*) AS n FROM r, q GROUP BY 1, 2")
def pollution_rose_counts(spark: SparkSession, d: str) -> DataFrame:
    return transport.pollution_rose(V.wind(spark, d))


def _metric_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    mean = f"(PARTITION BY {by})" if by else "()"
    return f""", q AS (SELECT *, avg(y_true) OVER {mean} AS o FROM x) SELECT {g}count(*) AS n, {R4('corr(y_true, y_pred)')} AS r, {R4('1 - sum((y_pred - y_true) ** 2) / sum((y_true - o) ** 2)')} AS r2,
{R4('sqrt(avg((y_pred - y_true) ** 2))')} AS rmse, {R4('avg(abs(y_pred - y_true))')} AS mae, {R4('avg(y_pred - y_true)')} AS mbe, {R4('sum(y_pred - y_true) / sum(y_true)')} AS nmb, {R4('sum(abs(y_pred - y_true)) / sum(y_true)')} AS nme,
{R4('1 - sum((y_pred - y_true) ** 2) / sum((abs(y_pred - o) + abs(y_true - o)) ** 2)')} AS ioa,
{R4('(var_pop(y_pred) - var_pop(y_true) + sqrt((var_pop(y_pred) - var_pop(y_true)) ** 2 + 4 * covar_pop(y_true, y_pred) ** 2)) / (2 * covar_pop(y_true, y_pred))')} AS slope FROM q{grp}"""


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    names = ("r", "r2", "rmse", "mae", "mbe", "nmb", "nme", "ioa", "slope")
    return df.select(*keys, "n", *(r4(F.col(c)).alias(c) for c in names))


@query(f"WITH {V.PAIRS_SQL}, x AS (SELECT * FROM pairs)" + _metric_sql("l_returnflag"))
def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.metrics_table(V.pairs(spark, d), ["l_returnflag"]), ["l_returnflag"])


@query(f"WITH {V.PAIRS_SQL}, b(lo, hi) AS (VALUES (0.0, 20000.0), (10000.0, 50000.0), (50000.0, 200000.0)), x AS (SELECT CAST(CAST(lo AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(hi AS BIGINT) AS VARCHAR) AS band, y_true, y_pred FROM pairs, b WHERE y_true >= lo AND y_true < hi)" + _metric_sql("band"))
def metrics_stratified(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.stratified_metrics(V.pairs(spark, d), [(0.0, 20000.0), (10000.0, 50000.0), (50000.0, 200000.0)]), ["band"])


_CONF = f"WITH {V.PAIRS_SQL}, z AS (SELECT {_band_sql('(y_true / 200)')} AS t, {_band_sql('(y_pred / 200)')} AS p FROM pairs), m AS (SELECT CAST(t AS INTEGER) AS true_band, CAST(p AS INTEGER) AS predicted_band, count(*) AS n FROM z GROUP BY 1, 2)"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(V.pairs(spark, d).select((F.col("y_true") / 200).alias("y_true"), (F.col("y_pred") / 200).alias("y_pred")))


@query(_CONF + f" SELECT true_band, predicted_band, n, {R4('n / (sum(n) OVER (PARTITION BY true_band))::DOUBLE')} AS share FROM m")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.normalised_confusion(_confusion(spark, d), "true").withColumn("share", r4(F.col("share")))


@query(_CONF + f", b AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS band), s AS (SELECT band, coalesce(sum(n) FILTER (WHERE true_band = band AND predicted_band = band), 0)::DOUBLE AS hit, coalesce(sum(n) FILTER (WHERE true_band = band), 0)::DOUBLE AS sup, coalesce(sum(n) FILTER (WHERE predicted_band = band), 0)::DOUBLE AS pre FROM b, m GROUP BY 1) SELECT band, CAST(sup AS BIGINT) AS support, {R4('CASE WHEN pre > 0 THEN hit / pre ELSE 0 END')} AS precision, {R4('CASE WHEN sup > 0 THEN hit / sup ELSE 0 END')} AS recall, {R4('CASE WHEN hit > 0 THEN 2 * (hit / pre) * (hit / sup) / (hit / pre + hit / sup) ELSE 0 END')} AS f1 FROM s")
def confusion_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_scores(_confusion(spark, d)).withColumns({c: r4(F.col(c)) for c in ("precision", "recall", "f1")})


_SCORES = f"WITH {V.PAIRS_SQL}, s AS (SELECT l_returnflag, abs(y_true - y_pred) AS score FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (ORDER BY score) - 1 AS grk, count(*) OVER () AS gn FROM s)"
_RANK = lambda n: f"ceil(least(1.0, ceil(({n} + 1) * (1 - 0.1)) / {n}) * ({n} - 1))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return V.pairs(spark, d).select("l_returnflag", F.abs(F.col("y_true") - F.col("y_pred")).alias("score"))


@query(_SCORES + f" SELECT {R4('min(score)')} AS q, max(gn) AS n FROM k WHERE grk >= {_RANK('gn')}")
def conformal_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.conformal_quantile(_scores(spark, d)).select(r4(F.col("q")).alias("q"), "n")


@query(_SCORES + f" SELECT l_returnflag, {R4('min(score)')} AS q, max(n) AS n FROM k WHERE rk >= {_RANK('n')} GROUP BY 1")
def conformal_mondrian(spark: SparkSession, d: str) -> DataFrame:
    return metrics.conformal_quantile(_scores(spark, d), by=["l_returnflag"]).select("l_returnflag", r4(F.col("q")).alias("q"), "n")


@query(f"WITH {V.PAIRS_SQL} SELECT {R4('avg(CAST(y_true BETWEEN y_pred - 1000 AND y_pred + 1500 AS INTEGER))')} AS picp, {R4('avg((y_pred + 1500) - (y_pred - 1000))')} AS mpiw, {R4('avg(CAST(y_true BETWEEN y_pred - 1000 AND y_pred + 1500 AS INTEGER)) - 0.9')} AS gap, count(*) AS n FROM pairs")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = V.pairs(spark, d).withColumns({"lower": F.col("y_pred") - 1000, "upper": F.col("y_pred") + 1500})
    return metrics.coverage_report(rows).select(r4(F.col("picp")).alias("picp"), r4(F.col("mpiw")).alias("mpiw"), r4(F.col("gap")).alias("gap"), "n")


@query("""WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem WHERE l_linestatus = 'F')
SELECT (CAST(abs((l_quantity - m1) / s1) > 1.5 AS INTEGER) + CAST(abs((l_extendedprice - m2) / s2) > 1.5 AS INTEGER)) / 2.0 <= 0.25 AS applicable, count(*) AS n FROM lineitem, s WHERE l_linestatus <> 'F' GROUP BY 1""")
def applicability_flag(spark: SparkSession, d: str) -> DataFrame:
    line = V.read(spark, d, "lineitem")
    out = metrics.applicability(line.filter("l_linestatus = 'F'"), line.filter("l_linestatus <> 'F'"), ["l_quantity", "l_extendedprice"], n_std=1.5)
    return out.groupBy("applicable").agg(F.count(F.lit(1)).alias("n"))


_Z = f"WITH {V.GRID_SQL}, m AS (SELECT i, j, median(v) AS med, count(v) AS n FROM grid GROUP BY 1, 2), a AS (SELECT i, j, median(abs(v - med)) * 1.4826 AS sc FROM grid JOIN m USING (i, j) GROUP BY 1, 2), z AS (SELECT g.*, CASE WHEN sc > 0 AND n >= 3 THEN (v - med) / sc END AS z FROM grid g JOIN m USING (i, j) JOIN a USING (i, j))"


@query(_Z + f" SELECT i, j, t, {R4('z')} AS z FROM z")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return grids.robust_z(V.grid(spark, d)).select("i", "j", "t", r4(F.col("z")).alias("z"))


@query(f"WITH {V.GRID_SQL} SELECT i, j, floor(quantile_cont(v, 0.95) * 10 + 0.5) / 10 AS percentile FROM grid GROUP BY 1, 2")
def percentile_surface(spark: SparkSession, d: str) -> DataFrame:
    return grids.percentile_surface(V.grid(spark, d)).select("i", "j", (F.floor(F.col("percentile") * 10 + 0.5) / 10).alias("percentile"))


_FIELD = f"{V.GRID_SQL}, f AS (SELECT i, j, avg(v) AS v FROM grid GROUP BY 1, 2)"


def _field(spark: SparkSession, d: str) -> DataFrame:
    return V.grid(spark, d).groupBy("i", "j").agg(F.avg("v").alias("v"))


@query(f"WITH {_FIELD}, m AS (SELECT median(v) AS med FROM f), s AS (SELECT median(abs(v - med)) * 1.4826 AS sc FROM f, m) SELECT i, j, {R4('(v - med) / sc')} AS z_spatial FROM f, m, s")
def spatial_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return grids.spatial_anomaly(_field(spark, d), degree=None).select("i", "j", r4(F.col("z_spatial")).alias("z_spatial"))


_TERMS = ["1.0", "y", "y * y", "x", "x * y", "x * x"]
_SURFACE = f"""WITH {_FIELD}, e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM f), p AS (SELECT i, j, v, 2.0 * (j - j0) / (j1 - j0) - 1 AS x, 2.0 * (i - i0) / (i1 - i0) - 1 AS y FROM f, e),
{V.least_squares_sql("p", _TERMS, "v", "fit")}, r AS (SELECT i, j, v - ({" + ".join(f"c{k} * {t}" for k, t in enumerate(_TERMS))}) AS r FROM p, fit)"""


@query(f"{_SURFACE}, m AS (SELECT median(r) AS med FROM r), s AS (SELECT median(abs(r - med)) * 1.4826 AS sc FROM r, m) SELECT i, j, {R4('(r - med) / sc')} AS z_spatial FROM r, m, s")
def spatial_anomaly_detrended(spark: SparkSession, d: str) -> DataFrame:
    return grids.spatial_anomaly(_field(spark, d), degree=2).select("i", "j", r4(F.col("z_spatial")).alias("z_spatial"))


@query(f"WITH {V.GRID_SQL}, g AS (SELECT * FROM grid WHERE month(t) IN (10, 11)), p AS (SELECT i, j, avg(v) AS mean, quantile_cont(v, 0.95) AS p FROM g GROUP BY 1, 2) SELECT g.i, g.j, g.t, {R4('mean')} AS mean, v >= p AS exceeds FROM g JOIN p USING (i, j)")
def season_climatology(spark: SparkSession, d: str) -> DataFrame:
    return grids.climatology(V.grid(spark, d), "post_monsoon").select("i", "j", "t", r4(F.col("mean")).alias("mean"), "exceeds")


@query(f"WITH {V.SOURCES_SQL}, w(source, k, w) AS (VALUES ('A', 0, 1.0), ('N', 1, 0.8), ('R', 2, 0.5)), x AS (SELECT src.*, k, w FROM src JOIN w USING (source)), f AS (SELECT i, j, sum(w * v) / sum(w) AS fused, CAST(max_by(k, w) AS INTEGER) AS provenance, count(*) AS n FROM x GROUP BY 1, 2), u AS (SELECT i, j, sum(w * (v - fused) ** 2) / sum(w) AS var FROM x JOIN f USING (i, j) GROUP BY 1, 2) SELECT i, j, {R4('fused')} AS fused, provenance, {R4('sqrt(var) * (1 + 1.0 / n)')} AS uncertainty FROM f JOIN u USING (i, j)")
def weighted_composite(spark: SparkSession, d: str) -> DataFrame:
    out = grids.weighted_composite(V.sources(spark, d), {"A": 1.0, "N": 0.8, "R": 0.5}, by=["i", "j"])
    return out.select("i", "j", r4(F.col("fused")).alias("fused"), "provenance", r4(F.col("uncertainty")).alias("uncertainty"))


_PROBS = "[" + ", ".join(repr(k / 20) for k in range(21)) + "]"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return grids.fit_quantile_map(V.pairs(spark, d), sat="y_pred", obs="y_true", region="l_returnflag", n=21)


@query(f"WITH {V.PAIRS_SQL}, m AS (SELECT 'all' AS region, quantile_cont(y_pred, {_PROBS}) AS s, quantile_cont(y_true, {_PROBS}) AS o FROM pairs UNION ALL SELECT l_returnflag, quantile_cont(y_pred, {_PROBS}), quantile_cont(y_true, {_PROBS}) FROM pairs GROUP BY 1) SELECT region, CAST(k AS INTEGER) AS k, {R4('s[k + 1]')} AS sat_q, {R4('o[k + 1]')} AS obs_q FROM m, (SELECT unnest(range(21)) AS k)")
def quantile_map_fit(spark: SparkSession, d: str) -> DataFrame:
    m = _mapping(spark, d).select(F.coalesce("region", F.lit("all")).alias("region"), F.posexplode(F.arrays_zip("sat_q", "obs_q")).alias("k", "x"))
    return m.select("region", "k", r4(F.col("x.sat_q")).alias("sat_q"), r4(F.col("x.obs_q")).alias("obs_q"))


@query(f"""WITH {V.PAIRS_SQL}, m AS (SELECT l_returnflag, quantile_cont(y_pred, {_PROBS}) AS s, quantile_cont(y_true, {_PROBS}) AS o FROM pairs GROUP BY 1),
x AS (SELECT p.*, s, o, least(greatest(len(list_filter(s, lambda q: q <= y_pred)), 1), 20) AS k FROM pairs p JOIN m USING (l_returnflag))
SELECT l_orderkey, l_linenumber, {R4('o[k] + (y_pred - s[k]) * (o[k + 1] - o[k]) / (s[k + 1] - s[k])')} AS mapped FROM x""")
def quantile_map_apply(spark: SparkSession, d: str) -> DataFrame:
    out = grids.apply_quantile_map(V.pairs(spark, d), _mapping(spark, d), sat="y_pred", region="l_returnflag")
    return out.select("l_orderkey", "l_linenumber", r4(F.col("mapped")).alias("mapped"))


_FULL = f"{V.GRID_SQL}, c AS (SELECT DISTINCT i, j FROM grid), q AS (SELECT DISTINCT t FROM grid), full_grid AS (SELECT c.i, c.j, q.t, g.v FROM c CROSS JOIN q LEFT JOIN grid g ON g.i = c.i AND g.j = c.j AND g.t = q.t)"


def _full(spark: SparkSession, d: str) -> DataFrame:
    g = V.grid(spark, d)
    return g.select("i", "j").distinct().crossJoin(F.broadcast(g.select("t").distinct())).join(g, ["i", "j", "t"], "left")


@query(f"WITH {_FULL} SELECT 'v' AS variable, count(*) AS n, count(*) - count(v) AS missing, {R4('(count(*) - count(v)) / count(*)::DOUBLE')} AS gap_fraction FROM full_grid")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    return grids.gap_report(_full(spark, d), ["v"]).withColumn("gap_fraction", r4(F.col("gap_fraction")))


@query(f"WITH {_FULL} SELECT i, j, t, {R4('coalesce(v, avg(v) OVER (PARTITION BY i, j), avg(v) OVER (), 0.0)')} AS filled FROM full_grid")
def cell_mean_fill(spark: SparkSession, d: str) -> DataFrame:
    return grids.mean_fill(_full(spark, d)).select("i", "j", "t", r4(F.col("filled")).alias("filled"))


@query(f"WITH {_FULL} SELECT i, j, t, {R4('coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), avg(v) OVER ())')} AS filled FROM full_grid")
def ffill_bfill(spark: SparkSession, d: str) -> DataFrame:
    return grids.time_fill(_full(spark, d)).select("i", "j", "t", r4(F.col("filled")).alias("filled"))


@query(f"WITH {_FIELD}, e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM f), s AS (SELECT f.i, f.j, least(greatest(f.i + a, i0), i1) AS ni, least(greatest(f.j + b, j0), j1) AS nj FROM f, e, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)) SELECT s.i, s.j, {R4('avg(g.v)')} AS box_mean FROM s LEFT JOIN f g ON g.i = s.ni AND g.j = s.nj GROUP BY 1, 2")
def box_mean(spark: SparkSession, d: str) -> DataFrame:
    return grids.box_mean(_field(spark, d)).select("i", "j", r4(F.col("box_mean")).alias("box_mean"))


#: Every station is an observation; the nodes are those of the view's whole grid.
_OBS_IDW = f"{V.STATIONS_SQL}, o AS (SELECT station AS id, lat, lon, station % 97 + 0.5 AS v FROM st), n AS (SELECT i * 100 + j AS node, 8.0 + 1.4 * i AS lat, 70.0 + 1.3 * j AS lon FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j))"


def _fill_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = V.stations(spark, d).select(F.col("station").alias("id"), "lat", "lon", (F.col("station") % 97 + 0.5).alias("v"))
    i, j = F.floor(F.col("id") / 20), F.col("id") % 20
    # As the SQL, whose 8.0 + 1.4 * i are decimals: rounded once.
    return obs, spark.range(400).select((i * 100 + j).alias("node"), ((80 + 14 * i) / 10).alias("lat"), ((700 + 13 * j) / 10).alias("lon"))


@query(f"""WITH {_OBS_IDW}, m AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM o), po AS (SELECT id, v, radians(lon - lon0) * cos(radians(lat0)) * 6371.0088 AS x, radians(lat - lat0) * 6371.0088 AS y FROM o, m),
pn AS (SELECT node, radians(lon - lon0) * cos(radians(lat0)) * 6371.0088 AS x, radians(lat - lat0) * 6371.0088 AS y FROM n, m), d AS (SELECT node, id, v, sqrt((po.x - pn.x) ** 2 + (po.y - pn.y) ** 2) AS d FROM pn, po),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, id) AS rn FROM d), e AS (SELECT node, sum(v / pow(d * d + 1e-12, 1.0)) / sum(1 / pow(d * d + 1e-12, 1.0)) AS est FROM k WHERE rn <= 8 GROUP BY 1) SELECT node, {R4('est')} AS estimate FROM e""")
def idw_fill(spark: SparkSession, d: str) -> DataFrame:
    return grids.idw(*_fill_inputs(spark, d)).select("node", r4(F.col("estimate")).alias("estimate"))


@query(f"""WITH {_FIELD}, {V.STATIONS_SQL}, p AS (SELECT station AS node, (lat - 8.0) / 1.4 AS y, (lon - 70.0) / 1.3 AS x FROM st), k AS (SELECT *, least(floor(y), 18) AS i0, least(floor(x), 18) AS j0 FROM p WHERE y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 19),
c AS (SELECT node, i0 + a AS i, j0 + b AS j, (CASE WHEN a = 1 THEN y - i0 ELSE 1 - (y - i0) END) * (CASE WHEN b = 1 THEN x - j0 ELSE 1 - (x - j0) END) AS w FROM k, (VALUES (0), (1)) AS aa(a), (VALUES (0), (1)) AS bb(b)),
s AS (SELECT node, count(f.v) AS n, sum(w * f.v) AS v FROM c JOIN f ON f.i = c.i AND f.j = c.j GROUP BY 1) SELECT p.node, {R4('CASE WHEN n = 4 THEN v END')} AS v FROM p LEFT JOIN s USING (node)""")
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    targets = V.stations(spark, d).select(F.col("station").alias("node"), "lat", "lon")
    # The view's cells are 1.4 by 1.3 degrees; longitudes are stretched to the square grid that the operator takes.
    square = targets.withColumn("lon", 70.0 + (F.col("lon") - 70.0) / 1.3 * 1.4)
    return grids.regrid(_field(spark, d), square, lat0=8.0, lon0=70.0, step=1.4, n_lat=20, n_lon=20).select("node", r4(F.col("v")).alias("v"))


@query(f"WITH {_FIELD} SELECT CAST(floor(i / 4) AS BIGINT) AS i, CAST(floor(j / 4) AS BIGINT) AS j, {R4('avg(v)')} AS v FROM f GROUP BY 1, 2")
def regrid_conservative(spark: SparkSession, d: str) -> DataFrame:
    return grids.regrid_conservative(_field(spark, d), factor=4).select("i", "j", r4(F.col("v")).alias("v"))


_CELLS = f"{_FIELD}, cells AS (SELECT i * 100 + j AS id, CAST(i AS DOUBLE) AS lat, CAST(j AS DOUBLE) AS lon, v FROM f)"
_KNN = f"{_CELLS}, e AS (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2), b.id) AS rn FROM cells a JOIN cells b ON a.id <> b.id AND abs(a.lat - b.lat) <= 4 AND abs(a.lon - b.lon) <= 4) WHERE rn <= 8)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return _field(spark, d).select((F.col("i") * 100 + F.col("j")).alias("id"), F.col("i").cast("double").alias("lat"), F.col("j").cast("double").alias("lon"), "v")


_GI = _KNN + """, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM cells), es AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM cells),
g AS (SELECT src AS id, sum(v) AS sv, count(*) AS c FROM es JOIN cells ON cells.id = es.dst GROUP BY 1), gi AS (SELECT g.id, (sv / c - m) / (sd * sqrt((n / c::DOUBLE - 1) / (n - 1))) AS z FROM g, s)"""
_TAIL = lambda z: f"(CASE WHEN {z} >= 0 THEN exp(-abs({z}) * abs({z}) / 2) / sqrt(2 * pi()) * (tt * (0.319381530 + tt * (-0.356563782 + tt * (1.781477937 + tt * (-1.821255978 + tt * 1.330274429))))) ELSE 1 - exp(-abs({z}) * abs({z}) / 2) / sqrt(2 * pi()) * (tt * (0.319381530 + tt * (-0.356563782 + tt * (1.781477937 + tt * (-1.821255978 + tt * 1.330274429))))) END)"


@query(f"WITH {_GI}, p AS (SELECT id, z, abs(z) AS az, 1 / (1 + 0.2316419 * abs(z)) AS tt FROM gi) SELECT id, {R4('z')} AS z, {R4(_TAIL('az'))} AS p FROM p")
def gi_star(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return spatial.gi_star(cells, spatial.knn_weights(cells, 8, reach=4.0)).select("id", r4(F.col("z")).alias("z"), r4(F.col("p")).alias("p"))


@query(f"WITH {_KNN}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM cells), z AS (SELECT id, (v - m) / sd AS z FROM cells, s), l AS (SELECT src AS id, avg(z) AS lag FROM e JOIN z ON z.id = e.dst GROUP BY 1) SELECT z.id, {R4('z * lag')} AS i, CAST(CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS INTEGER) AS quadrant FROM z JOIN l USING (id)")
def local_moran(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return spatial.local_moran(cells, spatial.knn_weights(cells, 8, reach=4.0)).select("id", r4(F.col("i")).alias("i"), "quadrant")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * l_tax * 10 AS p FROM lineitem), k AS (SELECT p, count(*) AS c FROM p GROUP BY 1), r AS (SELECT p, sum(c) OVER (ORDER BY p) AS rk, sum(c) OVER () AS m FROM k), cut AS (SELECT max(p) AS cut FROM r WHERE p <= rk / m * 0.05) SELECT coalesce(p <= cut, false) AS rejected, count(*) AS n FROM p, cut GROUP BY 1")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    tests = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * F.col("l_tax") * 10).alias("p"))
    return spatial.benjamini_hochberg(tests, 0.05).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


_Z_SPATIAL = "zs AS (SELECT c.*, (v - m) / (1.4826 * s) AS z_spatial FROM cells c, (SELECT median(v) AS m FROM cells), (SELECT median(abs(v - (SELECT median(v) FROM cells))) AS s FROM cells))"
_VOTES = f"""WITH {_KNN}, {_Z_SPATIAL}, s AS (SELECT avg(z_spatial) AS m, stddev_pop(z_spatial) AS sd, count(*) AS n FROM zs), es AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM cells),
g AS (SELECT src AS id, sum(z_spatial) AS sv, count(*) AS c FROM es JOIN zs ON zs.id = es.dst GROUP BY 1), gi AS (SELECT g.id, (sv / c - m) / (sd * sqrt((n / c::DOUBLE - 1) / (n - 1))) AS z FROM g, s),
gp AS (SELECT id, z, {_TAIL('abs(z)')} AS p FROM (SELECT id, z, 1 / (1 + 0.2316419 * abs(z)) AS tt FROM gi)),
k AS (SELECT p, count(*) AS c FROM gp GROUP BY 1), r AS (SELECT p, sum(c) OVER (ORDER BY p) AS rk, sum(c) OVER () AS m FROM k), cut AS (SELECT max(p) AS cut FROM r WHERE p <= rk / m * 0.2),
zm AS (SELECT id, (z_spatial - m) / sd AS z FROM zs, s), lag AS (SELECT src AS id, avg(zm.z) AS lag, count(*) AS c FROM e JOIN zm ON zm.id = e.dst GROUP BY 1),
lp AS (SELECT zm.id, z, lag, 2 * {_TAIL('x')} AS p FROM (SELECT zm.id, zm.z, lag, abs(lag) * sqrt(c) AS x, 1 / (1 + 0.2316419 * abs(lag) * sqrt(c)) AS tt FROM zm JOIN lag USING (id)) AS zm),
v AS (SELECT zs.id, coalesce(gp.p <= cut AND gp.z > 0, false) AS gi_vote, least(lp.p, 1) < 0.2 AND lp.z > 0 AND lp.lag > 0 AS lisa_vote, z_spatial > 2 AND zs.v >= (SELECT quantile_cont(v, 0.95) FROM cells) AS high_vote FROM zs JOIN gp USING (id) JOIN lp USING (id), cut)
SELECT id, gi_vote, lisa_vote, high_vote, CAST(gi_vote AS INTEGER) + CAST(lisa_vote AS INTEGER) + CAST(high_vote AS INTEGER) AS votes FROM v WHERE gi_vote OR lisa_vote OR high_vote"""


@query(_VOTES)
def consensus_votes(spark: SparkSession, d: str) -> DataFrame:
    field = grids.spatial_anomaly(_field(spark, d), degree=None)
    cells = field.select((F.col("i") * 100 + F.col("j")).alias("id"), F.col("i").cast("double").alias("lat"), F.col("j").cast("double").alias("lon"), "v", "z_spatial")
    return spatial.consensus(cells, spatial.knn_weights(cells, 8, reach=4.0), gi_alpha=0.2, lisa_alpha=0.2, votes=1)


_SLOPE = f"WITH {V.GRID_SQL}, s AS (SELECT i * 100 + j AS id, epoch(t::TIMESTAMP) / 86400 AS t, v FROM grid), p AS (SELECT a.id, sign(b.v - a.v) AS s, (b.v - a.v) / (b.t - a.t) AS m FROM s a JOIN s b ON a.id = b.id AND a.t < b.t)"


@query(_SLOPE + f" SELECT id, CAST(sum(s) AS BIGINT) AS s, {R4('median(m)')} AS sen_slope FROM p GROUP BY 1")
def ehsa_sen_slope(spark: SparkSession, d: str) -> DataFrame:
    cells = V.grid(spark, d).select((F.col("i") * 100 + F.col("j")).alias("id"), F.unix_date("t").alias("t"), "v")
    return spatial.sen_slope(cells).select("id", "s", r4(F.col("sen_slope")).alias("sen_slope"))


@query(None)
def ehsa_labels(spark: SparkSession, d: str) -> DataFrame:
    g = V.grid(spark, d)
    cells = g.select((F.col("i") * 100 + F.col("j")).alias("id"), F.col("i").cast("double").alias("lat"), F.col("j").cast("double").alias("lon"), F.unix_date("t").alias("t"), "v")
    weights = spatial.knn_weights(cells.select("id", "lat", "lon").distinct(), 8, reach=4.0)
    return spatial.emerging_hotspots(cells, weights, gi_alpha=0.2).select("id", "n_bins", "n_hot", "label")


_HAV = "2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


@query(f"""WITH RECURSIVE {V.STATIONS_SQL}, near AS MATERIALIZED (SELECT a.station AS s, b.station AS d FROM st a, st b WHERE {_HAV} <= 150), core AS MATERIALIZED (SELECT s AS id FROM near GROUP BY 1 HAVING count(*) >= 4),
ce AS MATERIALIZED (SELECT s, d FROM near WHERE s IN (SELECT id FROM core) AND d IN (SELECT id FROM core)),
reach(id, label) AS (SELECT id, id FROM core UNION SELECT ce.d, reach.label FROM reach JOIN ce ON ce.s = reach.id WHERE reach.label < ce.d),
l AS (SELECT id, min(label) AS label FROM reach GROUP BY 1), b AS (SELECT near.s AS id, min(label) AS edge FROM near JOIN l ON l.id = near.d GROUP BY 1)
SELECT st.station AS id, coalesce(l.label, b.edge, -1) AS cluster FROM st LEFT JOIN l ON l.id = st.station LEFT JOIN b ON b.id = st.station""")
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = V.stations(spark, d).select(F.col("station").alias("id"), "lat", "lon")
    return spatial.dbscan(points, eps_km=150.0, least=4)


@query(None)
def st_dbscan_polygons(spark: SparkSession, d: str) -> DataFrame:
    points = V.fires(spark, d).select(F.col("event_id").alias("id"), "lat", "lon", F.col("date").alias("day"), F.col("frp").alias("v"))
    return spatial.hotspot_polygons(points, spatial.dbscan(points, eps_km=150.0, least=4, eps_days=2.0))


_ENDS = f"{V.FIRES_SQL}, cw AS (SELECT {_CELL2}, avg(frp) AS value, count(*) AS n FROM fires WHERE lat BETWEEN 8 AND 36 AND lon BETWEEN 70 AND 96 GROUP BY 1, 2), w AS (SELECT *, CASE WHEN n / (max(n) OVER ())::DOUBLE > 0.8 THEN 1.0 WHEN n / (max(n) OVER ())::DOUBLE > 0.5 THEN 0.7 WHEN n / (max(n) OVER ())::DOUBLE > 0.2 THEN 0.42 ELSE 0.15 END AS wt FROM cw)"


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    return V.fires(spark, d).select("lat", "lon", F.col("frp").alias("v"))


@query(f"WITH {_ENDS} SELECT i, j, {R4('value * wt')} AS value, n FROM w")
def cwt_grid(spark: SparkSession, d: str) -> DataFrame:
    return transport.cwt(_endpoints(spark, d), box=V.BOX, step=2.0).select("i", "j", r4(F.col("value")).alias("value"), "n")


@query(f"WITH {V.FIRES_SQL}, q AS (SELECT quantile_cont(frp, 0.75) AS q FROM fires), cw AS (SELECT {_CELL2}, avg(CAST(frp > q AS INTEGER)) AS value, count(*) AS n FROM fires, q WHERE lat BETWEEN 8 AND 36 AND lon BETWEEN 70 AND 96 GROUP BY 1, 2) SELECT i, j, {R4('value')} AS value, n FROM cw")
def pscf_grid(spark: SparkSession, d: str) -> DataFrame:
    return transport.pscf(_endpoints(spark, d), box=V.BOX, step=2.0, weighted=False).select("i", "j", r4(F.col("value")).alias("value"), "n")


@query(f"WITH {_ENDS} SELECT CAST(8.0 + (i + 0.5) * 2.0 AS DOUBLE) AS lat, CAST(70.0 + (j + 0.5) * 2.0 AS DOUBLE) AS lon, {R4('value * wt')} AS value FROM w ORDER BY w.value * wt DESC, i, j LIMIT 1")
def peak_cell(spark: SparkSession, d: str) -> DataFrame:
    return transport.peak_cell(transport.cwt(_endpoints(spark, d), box=V.BOX, step=2.0)).select("lat", "lon", r4(F.col("value")).alias("value"))


@query(f"""WITH {V.STATIONS_SQL}, n AS (SELECT station, {_NODE} FROM st), {V.GRID_SQL}, {V.FIRES_SQL},
fc AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS t, count(*) AS c FROM fires GROUP BY 1) SELECT n.station, g.t AS day, {R4('g.v')} AS v, {R4('lag(g.v) OVER (PARTITION BY n.station ORDER BY g.t)')} AS v_lag1, coalesce(fc.c, 0) AS fire_count FROM n JOIN grid g USING (i, j) LEFT JOIN fc ON fc.t = g.t""")
def feature_matrix_join(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    burnt = V.fires(spark, d).groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("day")).agg(F.count(F.lit(1)).alias("fire_count"))
    rows = features.long_samples(V.grid(spark, d).withColumnRenamed("t", "day"), nodes).join(burnt, "day", "left").na.fill(0, ["fire_count"])
    out = features.add_lags(rows, ["v"], [1], group="station")
    return out.select("station", "day", r4(F.col("v")).alias("v"), r4(F.col("v_lag1")).alias("v_lag1"), "fire_count")


@query(f"WITH {V.SOURCES_SQL} SELECT i, j, max(v) FILTER (WHERE source = 'A') IS NOT NULL AS has_a, {R4('max(v) FILTER (WHERE source = ' + chr(39) + 'A' + chr(39) + ')')} AS a, {R4('max(v) FILTER (WHERE source = ' + chr(39) + 'R' + chr(39) + ')')} AS r FROM src WHERE source IN ('A', 'R') GROUP BY 1, 2")
def columns_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    src = V.sources(spark, d)
    of = lambda s, n: src.filter(F.col("source") == s).select("i", "j", F.col("v").alias(n))
    return grids.outer_merge([of("A", "a"), of("R", "r")], ["i", "j"]).select("i", "j", F.col("a").isNotNull().alias("has_a"), r4(F.col("a")).alias("a"), r4(F.col("r")).alias("r"))


@query(f"SELECT CAST(l_suppkey % 20 AS INTEGER) AS i, CAST(l_partkey % 20 AS INTEGER) AS j, {R4('median(l_extendedprice)')} AS v, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2")
def qa_median_composite(spark: SparkSession, d: str) -> DataFrame:
    px = V.read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("i"), (F.col("l_partkey") % 20).cast("int").alias("j"), F.col("l_discount").alias("qa"), F.col("l_extendedprice").alias("v"))
    return px.filter("qa >= 0.05").groupBy("i", "j").agg(r4(F.median("v")).alias("v"), F.count(F.lit(1)).alias("n"))

"""Domain views over the test tables (events, lineitem, supplier), and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLLUTANT_OF = {"view": "pm25", "click": "pm10", "purchase": "no2", "signup": "so2", "error": "co"}
FIVE = tuple(POLLUTANT_OF.values())
BOX = (70.0, 8.0, 96.0, 36.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column) -> Column:
    """Four decimals by floor(x + half), which both engines do alike."""
    return F.floor(c * 1e4 + 0.5) / 1e4


def _lat(c: str) -> Column:
    return F.lit(8.0) + (F.col(c) * 37 % 2800) / 100.0


def _lon(c: str) -> Column:
    return F.lit(70.0) + (F.col(c) * 61 % 2600) / 100.0


def obs(spark: SparkSession, sf_dir: str, stations: int = 5) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(p)) for e, p in POLLUTANT_OF.items()))
    value = F.when(F.col("event_type") == "error", F.col("value") / 10).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select((F.col("user_id") % stations).alias("station"), "ts", kind.alias("pollutant"), value.alias("value"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    return ids.select("station", _lat("station").alias("lat"), _lon("station").alias("lon"), F.concat(F.lit("Site "), F.col("station").cast("string")).alias("name"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select("event_id", F.to_date("ts").alias("date"), _lat("user_id").alias("lat"), _lon("user_id").alias("lon"), F.col("value").alias("frp"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy((F.col("l_suppkey") % 20).cast("int").alias("i"), (F.col("l_partkey") % 20).cast("int").alias("j"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("t")).agg(F.avg("l_extendedprice").alias("v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("y_true"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred"))


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round((F.col("l_discount") - 0.05) * 100).alias("u"), F.round((F.col("l_tax") - 0.04) * 100).alias("v"), F.col("l_quantity").alias("conc"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy((F.col("l_suppkey") % 20).cast("int").alias("i"), (F.col("l_partkey") % 20).cast("int").alias("j"), F.col("l_returnflag").alias("source")).agg(F.avg("l_extendedprice").alias("v"))


R4 = lambda x: f"floor(({x}) * 1e4 + 0.5) / 1e4"
_PLACE = "8.0 + (user_id * 37 % 2800) / 100.0 AS lat, 70.0 + (user_id * 61 % 2600) / 100.0 AS lon"


def obs_sql(n: int = 5) -> str:
    kinds = " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in POLLUTANT_OF.items())
    return f"obs AS (SELECT user_id % {n} AS station, ts, CASE event_type {kinds} END AS pollutant, CASE WHEN event_type = 'error' THEN value / 10 ELSE value END AS value FROM events)"


DAILY_SQL = "daily AS (SELECT station, CAST(ts AS DATE) AS day, " + ", ".join(f"avg(value) FILTER (WHERE pollutant = '{p}') AS {p}" for p in FIVE) + " FROM obs GROUP BY 1, 2)"
STATIONS_SQL = f"st AS (SELECT DISTINCT user_id AS station, {_PLACE}, 'Site ' || user_id AS name FROM events)"
FIRES_SQL = f"fires AS (SELECT event_id, CAST(ts AS DATE) AS date, {_PLACE}, value AS frp FROM events WHERE event_type = 'error')"
GRID_SQL = "grid AS (SELECT CAST(l_suppkey % 20 AS INTEGER) AS i, CAST(l_partkey % 20 AS INTEGER) AS j, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS t, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)"
PAIRS_SQL = "pairs AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y_true, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y_pred FROM lineitem)"
WIND_SQL = "wind AS (SELECT l_orderkey, l_linenumber, round((l_discount - 0.05) * 100) AS u, round((l_tax - 0.04) * 100) AS v, l_quantity AS conc FROM lineitem)"
SOURCES_SQL = "src AS (SELECT CAST(l_suppkey % 20 AS INTEGER) AS i, CAST(l_partkey % 20 AS INTEGER) AS j, l_returnflag AS source, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)"


def solved_sql(first: str, n: int, name: str) -> str:
    """Common table expressions that end in ``name`` (c0, c1, ...): a system (a0_0, ..., b0, ...) selected by ``first``, solved by Gauss-Jordan steps."""
    out = [f"{name}_0 AS ({first})"]
    for k in range(n):
        step = lambda r, c: f"{c.format(k)} / a{k}_{k}" if r == k else f"{c.format(r)} - a{r}_{k} * {c.format(k)} / a{k}_{k}"
        cells = [f"{step(r, f'a{{}}_{q}')} AS a{r}_{q}" for r in range(n) for q in range(k + 1, n)] + [f"{step(r, 'b{}')} AS b{r}" for r in range(n)]
        out.append(f"{name}_{k + 1} AS (SELECT {', '.join(cells)} FROM {name}_{k})")
    return ", ".join([*out, f"{name} AS (SELECT {', '.join(f'b{k} AS c{k}' for k in range(n))} FROM {name}_{n})"])


def least_squares_sql(rows: str, terms: list[str], target: str, name: str) -> str:
    """The normal equations of the terms, solved."""
    n = range(len(terms))
    sums = [f"sum(({terms[p]}) * ({terms[q]})) AS a{p}_{q}" for p in n for q in n] + [f"sum(({terms[p]}) * ({target})) AS b{p}" for p in n]
    return solved_sql(f"SELECT {', '.join(sums)} FROM {rows}", len(terms), name)

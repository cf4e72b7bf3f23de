"""The national air-quality index as Column expressions: no shuffle, no Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.constants import BREAKPOINTS, CATEGORIES, COLORS, INDEX_HIGH, INDEX_LOW, PARTICLES, POLLUTANTS


def clean(c: Column) -> Column:
    """NaN and infinities become null: missing is null everywhere in this package."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def sub_index(c: Column, pollutant: str, *, cleaned: bool = False) -> Column:
    """Piecewise-linear sub-index; a band owns its upper edge; held to 0..500; negative or missing gives null."""
    edges = BREAKPOINTS[pollutant]
    x = c if cleaned else clean(c)
    out = F.lit(None).cast("double")
    for k in reversed(range(6)):
        lo, hi, a, b = float(edges[k]), float(edges[k + 1]), float(INDEX_LOW[k]), float(INDEX_HIGH[k])
        value = (x - lo) / (hi - lo) * (b - a) + a
        out = value if k == 5 else F.when(x <= hi, value).otherwise(out)
    return F.when(x >= 0, F.least(F.greatest(out, F.lit(0.0)), F.lit(500.0)))


def _first_at(subs: dict[str, Column], top: Column) -> Column:
    return F.coalesce(*(F.when(subs[p] == top, F.lit(p)) for p in POLLUTANTS if p in subs))


def _top(subs: dict[str, Column]) -> Column:
    cols = [subs[p] for p in POLLUTANTS if p in subs]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def index_from_sub_indices(subs: dict[str, Column]) -> tuple[Column, Column]:
    """(index, responsible pollutant): the largest sub-index where three are present, a particle one among them."""
    known = {p: c for p, c in subs.items() if p in POLLUTANTS}
    if not known:
        raise ValueError(f"no known pollutant in {sorted(subs)}")
    present = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in known.values()))
    particle = reduce(lambda a, b: a | b, (known[p].isNotNull() for p in PARTICLES if p in known), F.lit(False))
    valid, top = (present >= 3) & particle, _top(known)
    return F.when(valid, top), F.when(valid, _first_at(known, top))


def responsible_pollutant(subs: dict[str, Column]) -> Column:
    """The first pollutant, in canonical order, with the largest sub-index."""
    return _first_at(subs, _top(subs))


def category_index(index: Column) -> Column:
    """Band 0..5 with the upper edge inside, -1 where the index is missing."""
    x = clean(index)
    out = F.lit(5)
    for k in reversed(range(5)):
        out = F.when(x <= INDEX_HIGH[k], k).otherwise(out)
    return F.when(x.isNull(), -1).otherwise(out).cast("short")


def _of_band(index: Column, names: tuple[str, ...]) -> Column:
    code = category_index(index)
    return F.when(code >= 0, F.element_at(F.array(*map(F.lit, names)), code.cast("int") + 1))


def category_name(index: Column) -> Column:
    return _of_band(index, CATEGORIES)


def category_color(index: Column) -> Column:
    return _of_band(index, COLORS)


def rgba(index: Column, nodata: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> Column:
    """Colour of the band as four numbers from 0 to 1; ``nodata`` where the index is missing."""
    lut = F.array(*(F.array(*(F.lit(int(c[k : k + 2], 16) / 255.0) for k in (1, 3, 5)), F.lit(1.0)) for c in COLORS))
    code = category_index(index)
    return F.when(code >= 0, F.element_at(lut, code.cast("int") + 1)).otherwise(F.array(*map(F.lit, nodata)))


def compute_aqi(df: DataFrame, *, column_map: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """Adds aqi, aqi_category and aqi_responsible from whatever pollutant columns there are."""
    names = {p: (column_map or {}).get(p, p) for p in POLLUTANTS}
    there = {p: n for p, n in names.items() if n in df.columns}
    if not there:
        raise ValueError("no pollutant column")
    # Each step is a projection of its own, so that no expression is repeated inside another.
    out = df.withColumns({f"_x_{p}": clean(F.col(n)) for p, n in there.items()}).withColumns({f"_s_{p}": sub_index(F.col(f"_x_{p}"), p, cleaned=True) for p in there})
    subs = {p: F.col(f"_s_{p}") for p in there}
    index, _ = index_from_sub_indices(subs)
    out = out.withColumn(f"{prefix}aqi", index)
    index = F.col(f"{prefix}aqi")
    out = out.withColumns({f"{prefix}aqi_responsible": F.when(index.isNotNull(), _first_at(subs, index)), f"{prefix}aqi_category": category_name(index)})
    return out.drop(*(f"_{k}_{p}" for k in "xs" for p in there))


def compute_aqi_grid(cube: DataFrame, *, column_map: dict[str, str] | None = None) -> DataFrame:
    """The same over a long cube: aqi as float, the responsible pollutant as a code among those present (-1: none), and the band."""
    there = [p for p in POLLUTANTS if (column_map or {}).get(p, p) in cube.columns]
    out = compute_aqi(cube, column_map=column_map)
    code = F.coalesce(*(F.when(F.col("aqi_responsible") == p, F.lit(k)) for k, p in enumerate(there)), F.lit(-1)).cast("short")
    return out.withColumn("aqi_responsible", code).withColumn("aqi_category", category_index(F.col("aqi"))).withColumn("aqi", F.col("aqi").cast("float"))

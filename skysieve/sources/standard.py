"""Products of reanalyses and satellites, read as tables, in the common names, units, box and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.constants import INDIA_BOX
from skysieve.functions.aqi import clean
from skysieve.functions.physics import in_box, pm25_from_species, relative_humidity

# Each product's variable names and the common ones.
PRODUCTS = {
    "era5": {"blh": "blh", "u10": "wind_u", "v10": "wind_v", "t2m": "t2m", "ssrd": "ssrd", "msl": "mslp", "tp": "precip", "d2m": "d2m"},
    "imdaa": {
        "HPBL": "blh", "hpbl": "blh", "blh": "blh", "UGRD_10m": "wind_u", "u10": "wind_u", "10u": "wind_u", "VGRD_10m": "wind_v", "v10": "wind_v", "10v": "wind_v", "TMP_2m": "t2m", "t2m": "t2m",
        "2t": "t2m", "RH_2m": "rh", "r2": "rh", "rh": "rh", "DSWRF": "ssrd", "ssrd": "ssrd", "APCP": "precip", "tp": "precip", "precip": "precip",
    },
    "cams": {"no2": "no2_col", "so2": "so2_col", "co": "co_col", "go3": "o3_col", "o3": "o3_col", "hcho": "hcho_col", "pm2p5": "pm25", "pm10": "pm10", "aod550": "aod"},
    "merra2": {"TOTEXTTAU": "aod", "PBLH": "blh"},
    "s5p": {"no2": "no2_col", "so2": "so2_col", "co": "co_col", "o3": "o3_col", "hcho": "hcho_col"},
}
# The least quality of a pixel by column product, and the depth of a digital number.
QUALITY = {"no2": 0.75, "so2": 0.50, "co": 0.50, "o3": 0.50, "hcho": 0.50, "ch4": 0.50, "aer_lh": 0.50}
MAIAC_SCALE, MAIAC_BANDS = 0.001, ("aod_055", "aod_047")
#: Variables that a day adds up; the others are averaged.
ACCUMULATED = ("precip", "ssrd")


def renamed(df: DataFrame, product: str) -> DataFrame:
    """Common variable and coordinate names. Of several columns that mean one variable the first with a value counts."""
    if product not in PRODUCTS:
        raise ValueError(f"unknown product {product!r}; one of {sorted(PRODUCTS)}")
    wanted: dict[str, list[str]] = {}
    for c in df.columns:
        name = {"latitude": "lat", "longitude": "lon"}.get(c, PRODUCTS[product].get(c, c))
        wanted.setdefault(name, []).append(c)
    return df.select(*(F.coalesce(*(F.col(f"`{c}`") for c in columns)).alias(name) for name, columns in wanted.items()))


def standardise(df: DataFrame, product: str, *, box: tuple[float, float, float, float] | None = INDIA_BOX) -> DataFrame:
    """Common names, the box, humidity from the dew point, and fine particles from species where they are there."""
    out = renamed(df, product)
    if box is not None and {"lat", "lon"} <= set(out.columns):
        out = out.filter(in_box(F.col("lat"), F.col("lon"), box))
    if {"t2m", "d2m"} <= set(out.columns):
        out = out.withColumn("rh", relative_humidity(F.col("t2m"), F.col("d2m"))).drop("d2m")
    species = ("SO4SMASS", "OCSMASS", "BCSMASS", "DUSMASS25", "SSSMASS")
    if product == "merra2" and any(c in out.columns for c in species):
        of = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("double")
        out = out.withColumn("pm25", pm25_from_species(*(of(c) for c in species)))
    return out


def daily(df: DataFrame, *, time: str = "time", keys: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """(day, keys, variables): sums of the accumulated variables, means of the others; a day without values is null."""
    there = [c for c in df.columns if c != time and c not in keys]
    how = lambda c: F.sum if c in ACCUMULATED else F.avg
    return df.groupBy(F.to_date(time).alias("day"), *keys).agg(*(how(c)(clean(F.col(c))).alias(c) for c in there))


def mask_quality(pixels: DataFrame, product: str, *, value: str, qa: str = "qa_value", least: float | None = None) -> DataFrame:
    """The value null where the quality is under the product's least, or missing."""
    bound = QUALITY[product] if least is None else least
    return pixels.withColumn(value, F.when(F.col(qa) >= bound, clean(F.col(value))))


def scaled_depth(pixels: DataFrame, band: str = "aod_055", *, qa: str = "AOD_QA", best_only: bool = True) -> DataFrame:
    """Adds aod: the band's digital number by its scale, null for other than best quality (bits 8 to 11 all 0) if asked for."""
    if band not in MAIAC_BANDS:
        raise ValueError(f"unknown band {band!r}; one of {MAIAC_BANDS}")
    aod = clean(F.col(band) * MAIAC_SCALE)
    return pixels.withColumn("aod", F.when(F.shiftright(F.col(qa), 8).bitwiseAND(0xF) == 0, aod) if best_only else aod)

"""Aerosol, humidity, wind, time, season and place as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.constants import AEROSOL, BOXES, COMPASS, EARTH_KM, EXTINCTION, EXTINCTION_BY_CODE, HEX_KM2, MET_FEATURES, SEASONS
from skysieve.functions.aqi import clean


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))  # least and greatest skip nulls


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (min lon, min lat, max lon, max lat), both ends included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def box_of(name: str) -> tuple[float, float, float, float]:
    return BOXES[name]


def box_polygon(box: tuple[float, float, float, float]) -> str:
    a, b, c, d = box
    return f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def growth(rh: Column, gamma: float = 0.6) -> Column:
    """Hygroscopic growth (1 - RH/100)^-gamma; RH outside 0..100 gives null, and 99 is the most that counts."""
    x = clean(rh)
    return F.when((x >= 0) & (x <= 100), F.pow(1 - F.least(x, F.lit(99.0)) / 100, F.lit(-gamma)))


def dry_aod(aod: Column, rh: Column, gamma: float = 0.6) -> Column:
    return clean(aod) / growth(rh, gamma)


def pbl_aod(aod: Column, blh: Column) -> Column:
    return F.when(clean(blh) > 0, clean(aod) / clean(blh))


def fnr(hcho: Column, no2: Column, min_no2: float = 1e-8) -> Column:
    """HCHO to NO2 ratio where both columns are credible."""
    return F.when((clean(hcho) >= 0) & (clean(no2) >= min_no2), clean(hcho) / clean(no2))


def fnr_map(hcho: Column, no2: Column, min_no2: float = 1e-30) -> Column:
    return F.when(clean(no2) > min_no2, clean(hcho) / clean(no2))


def fnr_regime(ratio: Column, voc_edge: float = 1.0, nox_edge: float = 2.0) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio < voc_edge, "VOC-limited").when(ratio > nox_edge, "NOx-limited").otherwise("transitional")


def relative_humidity(t: Column, dew: Column, *, kelvin: bool = True, a: float = 17.625, b: float = 243.04) -> Column:
    """Magnus formula, 0..100. The reanalysis reader uses a=17.62, b=243.12."""
    t, dew = (clean(x) - 273.15 if kelvin else clean(x) for x in (t, dew))
    return clip(100 * F.exp(a * dew / (b + dew)) / F.exp(a * t / (b + t)), 0.0, 100.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(clean(u) * clean(u) + clean(v) * clean(v))


def wind_dir(u: Column, v: Column, convention: str = "meteorological") -> Column:
    """Degrees; meteorological: where the wind comes from. Calm air has 180 (0 in the other convention)."""
    if convention not in ("meteorological", "oceanographic"):
        raise ValueError(f"unknown convention {convention!r}")
    u, v = clean(u), clean(v)
    met = convention == "meteorological"
    turned = F.pmod(F.degrees(F.atan2(-u, -v) if met else F.atan2(u, v)) + 360.0, F.lit(360.0))
    return F.when((u == 0) & (v == 0), 180.0 if met else 0.0).otherwise(turned)


def aerosol_code(index: Column | None = None, angstrom: Column | None = None, *, dust: float = 1.0, smoke: float = 1.0, coarse: float = 0.6, fine: float = 1.2) -> Column:
    """0 unknown, 1 dust, 2 smoke, 3 fine, 4 mixed, from an absorbing index, an Angstrom exponent, or both."""
    if index is None and angstrom is None:
        raise ValueError("neither an aerosol index nor an Angstrom exponent")
    code = lambda name: F.lit(AEROSOL.index(name))
    if index is not None and angstrom is not None:
        i, g = clean(index), clean(angstrom)
        out = F.when(i.isNull() | g.isNull(), code("unknown")).when((i < dust) & (g >= fine), code("fine_nonabsorbing"))
        out = out.when((i >= smoke) & (g >= fine), code("smoke_absorbing")).when((i >= dust) & (g <= coarse), code("dust"))
    elif angstrom is not None:
        g = clean(angstrom)
        out = F.when(g.isNull(), code("unknown")).when(g >= fine, code("fine_nonabsorbing")).when(g <= coarse, code("dust"))
    else:
        i = clean(index)
        out = F.when(i.isNull(), code("unknown")).when(i < dust, code("fine_nonabsorbing")).when(i >= dust, code("smoke_absorbing"))
    return out.otherwise(code("mixed")).cast("short")


def extinction(kind: str) -> float:
    return EXTINCTION[kind.lower()]


def extinction_of_code(code: Column) -> Column:
    return F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in EXTINCTION_BY_CODE.items()))


def aod_550(aod440: Column, aod675: Column) -> Column:
    """Angstrom power law between 440 and 675 nm; null unless both are positive."""
    a, b = clean(aod440), clean(aod675)
    alpha = -F.log(a / b) / F.lit(math.log(440.0 / 675.0))
    return F.when((a > 0) & (b > 0), a * F.pow(F.lit(550.0 / 440.0), -alpha))


def within_expected_error(sat: Column, ref: Column) -> Column:
    return F.abs(clean(sat) - clean(ref)) <= 0.05 + 0.15 * clean(ref)


def pm25_from_species(so4: Column, oc: Column, bc: Column, du25: Column, ss: Column) -> Column:
    zero = lambda c: F.coalesce(clean(c), F.lit(0.0))
    return (1.375 * zero(so4) + 1.6 * zero(oc) + zero(bc) + zero(du25) + 0.5 * zero(ss)) * 1e9


def surrogate_pm(aod: Column, *, coarse: bool = False) -> Column:
    return clean(aod) * (150.0 if coarse else 90.0)


def day_of_year_features(day: Column) -> tuple[Column, Column]:
    turn = 2 * math.pi * F.dayofyear(day) / 365.25
    return F.sin(turn), F.cos(turn)


def day_of_week_features(day: Column) -> tuple[Column, Column]:
    turn = 2 * math.pi * F.weekday(day) / 7
    return F.sin(turn), F.cos(turn)


def season_of(day: Column) -> Column:
    month = F.month(day)
    return F.coalesce(*(F.when(month.isin(*[m for m, s in SEASONS.items() if s == name]), F.lit(name)) for name in dict.fromkeys(SEASONS.values())))


def burning_season(day: Column) -> Column:
    return F.when(F.month(day).isin(10, 11), "oct_nov").when(F.month(day).isin(4, 5), "apr_may").otherwise("other")


def region_of(lat: Column, lon: Column) -> Column:
    return F.when(lat.between(24, 31) & lon.between(73, 88), "IGP").when(lat <= 15, "Peninsula").when((lon <= 72.5) | (lon >= 90), "Coastal").otherwise("Central")


def compass(bearing: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(F.pmod(bearing, F.lit(360.0)) / 45 + 0.5) % 8 + 1).cast("int"))


def bearing(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Initial great-circle bearing, 0..360."""
    a, b, d = F.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def haversine_km(lat0: Column, lon0: Column, lat: Column, lon: Column, radius: float = 6371.0088) -> Column:
    a, b = F.radians(lat0), F.radians(lat)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def station_id(name: Column, lat: Column, lon: Column) -> Column:
    """CPCB- and the first eight hex digits of a SHA-1 of name and place, whatever the name's case."""
    place = F.concat_ws("|", F.trim(F.lower(name)), F.round(lat.cast("double"), 3).cast("string"), F.round(lon.cast("double"), 3).cast("string"))
    return F.concat(F.lit("CPCB-"), F.upper(F.substring(F.sha1(place.cast("binary")), 1, 8)))


def _hex_width(resolution: Column | int) -> Column:
    """Half the distance of neighbouring centres' rows, in the unit plane, of hexagons with an area of the sphere's part at a resolution."""
    r = resolution if isinstance(resolution, Column) else F.lit(resolution)
    # A regular hexagon of side a has the area 3 sqrt(3) / 2 a^2; HEX_KM2 / 7^r of a sphere of EARTH_KM.
    return F.sqrt(F.lit(2 * HEX_KM2 / (3 * math.sqrt(3) * EARTH_KM**2)) / F.pow(F.lit(7.0), r))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of the value, which is computed once and not written out wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hex_at(x: Column, y: Column, side: Column) -> Column:
    """Axial numbers (q, r) of the hexagon that holds a place: rounded in cube coordinates, the axis rounded most is the others' rest."""

    def rounded(a: Column) -> Column:
        dq, dr, ds = F.abs(F.round(a["q"]) - a["q"]), F.abs(F.round(a["r"]) - a["r"]), F.abs(F.round(a["s"]) - a["s"])
        q = F.when((dq > dr) & (dq > ds), -F.round(a["r"]) - F.round(a["s"])).otherwise(F.round(a["q"]))
        r = F.when((dq > dr) & (dq > ds), F.round(a["r"])).when(dr > ds, -F.round(a["q"]) - F.round(a["s"])).otherwise(F.round(a["r"]))
        return F.struct(q.cast("long").alias("q"), r.cast("long").alias("r"))

    def axial(p: Column) -> Column:
        q, r = (math.sqrt(3) / 3 * p["x"] - p["y"] / 3) / p["side"], (2 / 3 * p["y"]) / p["side"]
        return _let(F.struct(q.alias("q"), r.alias("r")), lambda a: _let(F.struct(a["q"].alias("q"), a["r"].alias("r"), (-a["q"] - a["r"]).alias("s")), rounded))

    return _let(F.struct(x.alias("x"), y.alias("y"), side.alias("side")), axial)


def _hex_name(resolution: Column | int, q: Column, r: Column) -> Column:
    """Null where a number is missing."""
    res = resolution.cast("string") if isinstance(resolution, Column) else F.lit(str(resolution))
    return F.concat(res, F.lit(":"), q.cast("string"), F.lit(":"), r.cast("string"))


def cell_id(lat: Column, lon: Column, resolution: int = 7) -> Column:
    """Hexagonal cell as ``resolution:q:r``; missing coordinates give null.

    Hexagons tile the equal-area cylindrical plane (x: longitude, y: sine of
    latitude), so a resolution's cells have one area everywhere, a seventh of the
    next coarser's; the areas are those of the common icosahedral system, but ids
    are not, and cells do not join across the date line.
    """
    at = _hex_at(F.radians(clean(lon)), F.sin(F.radians(clean(lat))), _hex_width(resolution))
    return _let(at, lambda h: _hex_name(resolution, h["q"], h["r"]))


def _parts(cell: Column, body) -> Column:  # noqa: ANN001
    """``body`` of resolution, q and r."""
    return _let(F.split(cell, ":"), lambda p: body(p[0].cast("int"), p[1].cast("long"), p[2].cast("long")))


def _hex_place(res: Column, q: Column, r: Column) -> Column:
    side = _hex_width(res)
    return F.struct((side * (math.sqrt(3) * q + math.sqrt(3) / 2 * r)).alias("x"), (side * 1.5 * r).alias("y"))


def cell_center(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude; centres of cells over a pole's edge are held to the pole."""
    at = _parts(cell, _hex_place)
    return F.degrees(F.asin(F.least(F.greatest(at["y"], F.lit(-1.0)), F.lit(1.0)))), F.degrees(at["x"])


def cell_resolution(cell: Column) -> Column:
    return F.split(cell, ":")[0].cast("int")


def cell_parent(cell: Column, resolution: int) -> Column:
    """The coarser cell that holds the cell's centre."""
    up = lambda at: _let(_hex_at(at["x"], at["y"], _hex_width(resolution)), lambda h: _hex_name(resolution, h["q"], h["r"]))
    return _let(_parts(cell, _hex_place), up)


def cell_disk(cell: Column, k: int = 1) -> Column:
    """The cell and its neighbours within k steps, as an array of 3k(k + 1) + 1 ids."""
    steps = [(a, b) for a in range(-k, k + 1) for b in range(max(-k, -a - k), min(k, -a + k) + 1)]
    return _parts(cell, lambda res, q, r: F.array(*(_hex_name(res, q + a, r + b) for a, b in steps)))


def disk_size(k: int) -> int:
    return 3 * k * (k + 1) + 1


def cell_distance(a: Column, b: Column) -> Column:
    """Steps from cell to cell, of one resolution."""
    q, r = (F.split(b, ":")[k].cast("long") - F.split(a, ":")[k].cast("long") for k in (1, 2))
    return ((F.abs(q) + F.abs(r) + F.abs(q + r)) / 2).cast("long")


def add_physics_features(df: DataFrame) -> DataFrame:
    """Adds the derived columns whose inputs are there."""
    has, c = set(df.columns), F.col
    new: dict[str, Column] = {}
    if {"aod", "blh"} <= has:
        new["aod_pbl"] = pbl_aod(c("aod"), c("blh"))
    if {"aod", "rh"} <= has:
        new["aod_dry"] = dry_aod(c("aod"), c("rh"))
    if {"hcho_col", "no2_col"} <= has:
        new["fnr"] = fnr(c("hcho_col"), c("no2_col"))
    if {"wind_u", "wind_v"} <= has:
        new |= {"wind_speed": wind_speed(c("wind_u"), c("wind_v")), "wind_dir": wind_dir(c("wind_u"), c("wind_v"))}
    if has & {"aer_ai", "angstrom"}:
        new["aerosol_type"] = aerosol_code(c("aer_ai") if "aer_ai" in has else None, c("angstrom") if "angstrom" in has else None)
    return df.withColumns(new) if new else df


def ensure_relative_humidity(df: DataFrame) -> DataFrame:
    return df.withColumn("rh", relative_humidity(F.col("t2m"), F.col("d2m"))) if "rh" not in df.columns and {"t2m", "d2m"} <= set(df.columns) else df


def build_met_stack(df: DataFrame, keys: tuple[str, ...] = ("time", "lat", "lon"), features: tuple[str, ...] = MET_FEATURES) -> DataFrame:
    """The met features that are there or can be derived, as floats, with the keys."""
    df = ensure_relative_humidity(df)
    if {"wind_u", "wind_v"} <= set(df.columns):
        df = df.withColumns({"wind_speed": wind_speed(F.col("wind_u"), F.col("wind_v")), "wind_dir": wind_dir(F.col("wind_u"), F.col("wind_v"))})
    return df.select(*(k for k in keys if k in df.columns), *(F.col(f).cast("float").alias(f) for f in features if f in df.columns))

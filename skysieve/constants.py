"""Fixed values of the national index and of the published methods used here."""

from __future__ import annotations

POLLUTANTS = ("pm25", "pm10", "no2", "so2", "co", "o3", "nh3", "pb")
PARTICLES = ("pm25", "pm10")

# Concentration edges of the six bands, and the index at each band's low and high edge.
BREAKPOINTS = {
    "pm25": (0, 30, 60, 90, 120, 250, 380),
    "pm10": (0, 50, 100, 250, 350, 430, 510),
    "no2": (0, 40, 80, 180, 280, 400, 520),
    "so2": (0, 40, 80, 380, 800, 1600, 2620),
    "co": (0, 1, 2, 10, 17, 34, 51),
    "o3": (0, 50, 100, 168, 208, 748, 1288),
    "nh3": (0, 200, 400, 800, 1200, 1800, 2400),
    "pb": (0, 0.5, 1, 2, 3, 3.5, 4),
}
INDEX_LOW = (0, 51, 101, 201, 301, 401)
INDEX_HIGH = (50, 100, 200, 300, 400, 500)
CATEGORIES = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")
COLORS = ("#009865", "#A3C853", "#FFF833", "#F29C33", "#E93F33", "#AF2D24")

# Boxes (min lon, min lat, max lon, max lat).
BOXES = {"india": (68.0, 6.0, 98.0, 38.0), "igp": (73.0, 24.0, 88.0, 31.0), "punjab_haryana": (73.5, 28.5, 77.5, 32.5), "forest_belt": (73.0, 18.0, 96.0, 31.0)}
INDIA_BOX = BOXES["india"]
EARTH_KM, EARTH_M = 6371.0088, 6371000.0
# Fixed value: mean area of the coarsest hexagons; each resolution's is a seventh of the one before.
HEX_KM2 = 4357449.416

# Season of each month.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "pre_monsoon", 4: "pre_monsoon", 5: "pre_monsoon", 6: "monsoon", 7: "monsoon", 8: "monsoon", 9: "monsoon", 10: "post_monsoon", 11: "post_monsoon"}
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

# Grams of species for each kilogram of dry matter burnt, and the scaling of three inventories.
EMISSION_FACTORS = {
    "crop_residue": {"hcho": 2.30, "nmvoc": 18.0, "co": 92.0, "co2": 1430.0, "pm25": 6.30, "ch4": 5.80, "no2": 3.10, "nh3": 2.20},
    "tropical_forest": {"hcho": 1.73, "nmvoc": 22.0, "co": 93.0, "co2": 1640.0, "pm25": 9.10, "ch4": 5.07, "no2": 2.55, "nh3": 1.33},
    "savanna": {"hcho": 1.20, "nmvoc": 8.5, "co": 63.0, "co2": 1690.0, "pm25": 5.20, "ch4": 1.94, "no2": 3.90, "nh3": 0.52},
}
CONSUMPTION, DAY_SECONDS = 0.368, 86400.0
INVENTORIES = {"FINN": 1.0, "GFAS": 0.7, "QFED": 1.8}

# How far each sensor's depths are trusted against each other.
SENSOR_RELIABILITY = {"maiac": 1.0, "modis": 0.9, "viirs": 0.8, "insat": 0.5, "merra2": 0.6, "cams": 0.6}
# Aerosol classes by code, and mass extinction efficiencies (m2/g).
AEROSOL = ("unknown", "dust", "smoke_absorbing", "fine_nonabsorbing", "mixed")
EXTINCTION = {"sulfate": 5.0, "organic_carbon": 4.0, "black_carbon": 9.0, "dust": 0.6, "sea_salt": 3.0, "fine_pollution": 4.5, "coarse_dust": 0.7}
EXTINCTION_BY_CODE = {1: 0.7, 2: 9.0, 3: 4.5, 4: 4.5}
# Hours of the running mean behind a daily maximum; units other than ug/m3.
AVERAGING_HOURS = {"co": 8, "o3": 8}
UNITS = {"co": "mg/m3"}
# Names of the meteorological predictors.
MET_FEATURES = ("blh", "rh", "wind_speed", "wind_dir", "wind_u", "wind_v", "t2m", "ssrd", "precip", "mslp")

"""Declared schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _doubles(*names):
    return [T.StructField(n, T.DoubleType()) for n in names]


# Column names of the hourly weather table.
HOURLY_WEATHER = (
    "Temperature_C",
    "Humidity_percent",
    "Rain_mm",
    "Wind_Speed_kmh",
    "Wind_Dir_deg",
    "Pressure_hPa",
    "Solar_Radiation_Wm2",
    "Soil_Temp_C",
    "Soil_Moisture",
)

# Weather service names and the table names they become.
SOURCE_NAMES = {
    "temperature_2m": "Temperature_C",
    "relative_humidity_2m": "Humidity_percent",
    "precipitation": "Rain_mm",
    "wind_speed_10m": "Wind_Speed_kmh",
    "wind_direction_10m": "Wind_Dir_deg",
    "surface_pressure": "Pressure_hPa",
    "shortwave_radiation": "Solar_Radiation_Wm2",
    "soil_temperature_0_to_7cm": "Soil_Temp_C",
    "soil_moisture_0_to_7cm": "Soil_Moisture",
}

# Forecast targets.
DAILY_TARGETS = (
    "Temperature_C_mean",
    "Humidity_percent_mean",
    "Rain_mm_sum",
    "Wind_Speed_kmh_mean",
    "Pressure_hPa_mean",
    "Solar_Radiation_Wm2_mean",
    "Soil_Temp_C_mean",
    "Soil_Moisture_mean",
)
HOURLY_TARGETS = (
    "Temperature_C",
    "Humidity_percent",
    "Wind_Speed_kmh",
    "Solar_Radiation_Wm2",
)

# Label, columns that leak it, and keys.
LABEL = "Fire_Occurred"
LEAK_COLUMNS = ("fire_count", "mean_brightness", "max_frp", "Burned_Area_hectares")
KEY_COLUMNS = ("City", "Date", "Timestamp")
NOT_FEATURES = KEY_COLUMNS + (LABEL,) + LEAK_COLUMNS + ("Latitude", "Longitude")

STATIC_GEOGRAPHY = ("Elevation", "Slope", "Trees_pct", "Urban_pct", "Pop_Total")

# Physical range per variable.
BOUNDS = {
    "Temperature_C_mean": (-60.0, 60.0),
    "Temperature_C": (-60.0, 60.0),
    "Humidity_percent_mean": (0.0, 100.0),
    "Humidity_percent": (0.0, 100.0),
    "Rain_mm_sum": (0.0, 500.0),
    "Rain_mm": (0.0, 100.0),
    "Wind_Speed_kmh_mean": (0.0, 200.0),
    "Wind_Speed_kmh": (0.0, 200.0),
    "Pressure_hPa_mean": (800.0, 1100.0),
    "Pressure_hPa": (800.0, 1100.0),
    "Solar_Radiation_Wm2_mean": (0.0, 1400.0),
    "Solar_Radiation_Wm2": (0.0, 1400.0),
    "Soil_Moisture_mean": (0.0, 1.0),
    "Soil_Moisture": (0.0, 1.0),
}
# The forecast tables bound soil temperature too.
FORECAST_BOUNDS = {**BOUNDS, "Soil_Temp_C_mean": (-20.0, 60.0)}

# Risk tiers by lower bound, and their colours.
TIERS = (("Low", 0.0), ("Moderate", 0.15), ("High", 0.35), ("Extreme", 0.60))
TIER_COLOURS = {
    "Low": "#3FA773",
    "Moderate": "#D8A31D",
    "High": "#D96C3B",
    "Extreme": "#B73333",
}

# The sixteen monitored cities.
CITIES = {
    "Baku": (40.4093, 49.8671),
    "Ganja": (40.6828, 46.3606),
    "Mingachevir": (40.7639, 47.0595),
    "Shirvan": (39.9317, 48.9299),
    "Lankaran": (38.7523, 48.8475),
    "Shaki": (41.1975, 47.1694),
    "Nakhchivan": (39.2089, 45.4122),
    "Yevlakh": (40.6183, 47.1500),
    "Quba": (41.3611, 48.5261),
    "Khachmaz": (41.4635, 48.8060),
    "Gabala": (40.9982, 47.8468),
    "Shamakhi": (40.6303, 48.6414),
    "Jalilabad": (39.2089, 48.2986),
    "Barda": (40.3744, 47.1266),
    "Zaqatala": (41.6296, 46.6433),
    "Shabran": (41.2156, 48.8544),
}

# Lags, windows, splits, horizons.
DAILY_LAGS = (1, 2, 3, 5, 7, 14, 30)
DAILY_WINDOWS = (3, 7, 14, 30)
HOURLY_LAGS = (1, 3, 6, 12, 24)
HOURLY_WINDOWS = (6, 12, 24)
EVENT_WINDOWS = (7, 14, 30, 90)
TRAIN_END = "2024-01-01"
TEST_START = "2025-01-01"
HOLDOUT_DAYS = 30
HOLDOUT_HOURS = 168
BUFFER_KM = 20.0
KM_PER_DEGREE = 111.32
SEED = 42

WEATHER_HOURLY = T.StructType(
    [T.StructField("Timestamp", T.TimestampNTZType()), T.StructField("City", T.StringType())]
    + _doubles(*HOURLY_WEATHER)
)
EVENTS_DAILY = T.StructType(
    [
        T.StructField("City", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("fire_count", T.LongType()),
        T.StructField("mean_brightness", T.DoubleType()),
        T.StructField("max_frp", T.DoubleType()),
        T.StructField(LABEL, T.IntegerType()),
    ]
)
BURNED_AREA = T.StructType(
    [T.StructField("City", T.StringType()), T.StructField("Date", T.DateType())]
    + _doubles("Burned_Area_hectares")
)
VEGETATION = T.StructType(
    [T.StructField("City", T.StringType()), T.StructField("Date", T.DateType())] + _doubles("NDBI", "NDVI")
)
STATIC = T.StructType(
    [T.StructField("City", T.StringType())]
    + _doubles(*STATIC_GEOGRAPHY, "Road_Length_m", "Intersections", "Latitude", "Longitude")
)
PUBLIC_HOURLY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
    ]
)
CHECK = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("passed", T.BooleanType(), False),
        T.StructField("detail", T.StringType()),
    ]
)

"""Table shapes and fixed values of the two datasets."""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, note: str) -> T.StructField:
    return T.StructField(name, kind, True, {"comment": note})


FIRE_TABLE = "VIIRS_Thermal_Records"

FIRES = T.StructType(
    [
        _field("uid", T.StringType(), "key: md5 of position, acquisition and satellite"),
        _field("latitude", T.DoubleType(), "centre of the 375 m fire pixel, degrees"),
        _field("longitude", T.DoubleType(), "centre of the 375 m fire pixel, degrees"),
        _field("brightness_temp_i4", T.DoubleType(), "I-4 channel brightness temperature, Kelvin"),
        _field("brightness_temp_i5", T.DoubleType(), "I-5 channel brightness temperature, Kelvin"),
        _field("frp_mw", T.DoubleType(), "fire radiative power, megawatts"),
        _field("acquisition_timestamp", T.TimestampNTZType(), "time of detection, UTC"),
        _field("satellite", T.StringType(), "N = Suomi NPP, N20 = NOAA-20, N21 = NOAA-21"),
        _field("version", T.StringType(), "processing version"),
        _field("confidence", T.StringType(), "nominal or high once loaded"),
        _field("day_night", T.StringType(), "D = day, N = night"),
        _field("hours_old", T.DoubleType(), "whole hours since detection when first pulled"),
    ]
)

# Attribute names of the raw feed.
FEED = T.StructType(
    [
        T.StructField("OBJECTID", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("bright_ti4", T.DoubleType()),
        T.StructField("bright_ti5", T.DoubleType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("acq_date", T.StringType()),
        T.StructField("acq_time", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("daynight", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("hours_old", T.DoubleType()),
    ]
)

FEED_PAGE = T.StructType(
    [
        T.StructField(
            "features", T.ArrayType(T.StructType([T.StructField("attributes", FEED)]))
        )
    ]
)

# Feed attribute -> table column.
FEED_NAMES = {
    "OBJECTID": "object_id",
    "bright_ti4": "brightness_temp_i4",
    "bright_ti5": "brightness_temp_i5",
    "frp": "frp_mw",
    "acq_date": "acquisition_date",
    "acq_time": "acquisition_time",
    "daynight": "day_night",
}

# Confidence levels that a load keeps.
LOADED_CONFIDENCE = ["nominal", "high"]

# Fill markers that stand for a missing value.
NUMERIC_FILLS = [-9999, 9999]
TEXT_FILLS = ["", "N/A", "nan"]

# Kilograms of gas per megajoule, and 100-year warming potentials.
CO2_KG_PER_MJ = 1.37
CH4_KG_PER_MJ = 0.0048
N2O_KG_PER_MJ = 0.00020
CO_KG_PER_MJ = 0.063
CH4_WARMING = 28
N2O_WARMING = 265

# The water tables whose rows are joined with the region lookup.
WATER_TABLES = ["Baseline_Annual", "Baseline_Monthly", "Future_Annual"]
REGION_TABLE = "Region_Lookup"
REGION_COLUMNS = ["name_0", "pfaf_id", "name_1", "area_km2", "gid_0"]
REGION_REQUIRED = ["name_0", "name_1", "gid_0"]

# Parts of the coded column names and their long forms.
SCENARIOS = {
    "bau": "Business as Usual",
    "opt": "Optimistic",
    "pes": "Pessimistic",
}
SCENARIO_YEARS = {
    "30": "2030 (2015-2045)",
    "50": "2050 (2035-2065)",
    "80": "2080 (2065-2095)",
}
FUTURE_INDICATORS = {
    "ba": "Blue Water Availability",
    "ww": "Withdrawals",
    "ws": "Water Stress",
    "wd": "Water Depletion",
    "iv": "Interannual Variability",
    "sv": "Seasonal Variability",
}
FUTURE_TYPES = {
    "r": "Raw Value (Median of 5 GCMs)",
    "s": "Score [0-5 scale]",
    "l": "Label (Threshold Explanation)",
    "c": "Category (Integer for Visuals)",
}
FUTURE_KEYS = {"fid": "Feature ID", "pfaf_id": "Pfafstetter ID"}
MONTHLY_INDICATORS = {
    "bws": "Baseline_Water_Stress",
    "bwd": "Baseline_Water_Depletion",
    "iav": "Interannual_Variability",
}
MONTHLY_TYPES = {
    "raw": "Raw_Value",
    "score": "Score",
    "cat": "Category",
    "label": "Label",
}
MONTHLY_KEY = "Pfafstetter_ID"
MONTH_NAMES = [
    "JANUARY",
    "FEBRUARY",
    "MARCH",
    "APRIL",
    "MAY",
    "JUNE",
    "JULY",
    "AUGUST",
    "SEPTEMBER",
    "OCTOBER",
    "NOVEMBER",
    "DECEMBER",
]

# Words that send a question to the fire or the water tables.
FIRE_WORDS = [
    "fire", "fires", "wildfire", "wildfires", "burn", "burning", "burnt",
    "thermal", "hotspot", "hotspots", "smoke", "flame", "viirs",
    "blaze", "inferno", "ignition", "combustion",
]
WATER_WORDS = [
    "water", "flood", "flooding", "drought", "precipitation", "rainfall",
    "river", "rivers", "lake", "lakes", "stream", "streams",
    "aquatic", "hydro", "hydrological", "watershed", "aqueduct",
    "reservoir", "groundwater", "aquifer",
]
PLACE_PATTERN = r"(?:in|around|near|at)\s+([A-Z][a-zA-Z\s,]+?)(?:\s+area|\s*\?|$|,)"

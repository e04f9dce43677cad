"""Fixed place tables of the validation questions. Small by construction: constants in this file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberbasin.plans.local import local_rows

# City centres (latitude, longitude).
CITIES = {
    "Nairobi": (-1.2921, 36.8219),
    "Vancouver": (49.2827, -123.1207),
    "Jakarta": (-6.2088, 106.8456),
    "Rome": (41.9028, 12.4964),
    "Cairo": (30.0444, 31.2357),
    "Buenos Aires": (-34.6037, -58.3816),
    "Mumbai": (19.0760, 72.8777),
    "Chicago": (41.8781, -87.6298),
    "Lima": (-12.0464, -77.0428),
    "Tokyo": (35.6895, 139.6917),
    "Kinshasa": (-4.4419, 15.2663),
    "Berlin": (52.5200, 13.4050),
    "Bangkok": (13.7563, 100.5018),
    "Toronto": (43.6532, -79.3832),
    "Accra": (5.6037, -0.1870),
    "Sydney": (-33.8688, 151.2093),
    "Mexico City": (19.4326, -99.1332),
    "Moscow": (55.7558, 37.6173),
    "Tehran": (35.6892, 51.3890),
    "Cape Town": (-33.9249, 18.4241),
}

# Country centres (latitude, longitude).
COUNTRIES = {
    "India": (22.0, 78.0),
    "China": (35.0, 103.0),
    "Brazil": (-10.0, -55.0),
    "Argentina": (-34.0, -64.0),
    "Australia": (-25.0, 133.0),
    "Indonesia": (-2.0, 118.0),
    "United States": (39.0, -98.0),
    "Canada": (56.0, -106.0),
    "Russia": (60.0, 90.0),
    "South Africa": (-30.0, 25.0),
    "Mexico": (23.0, -102.0),
    "Turkey": (39.0, 35.0),
    "Greece": (39.0, 22.0),
    "Nigeria": (10.0, 8.0),
    "Kenya": (0.5, 37.5),
    "Saudi Arabia": (24.0, 45.0),
    "Iran": (32.0, 53.0),
    "Spain": (40.0, -4.0),
    "Italy": (42.0, 12.0),
    "France": (46.0, 2.0),
    "Germany": (51.0, 10.0),
    "Chile": (-33.0, -71.0),
    "Pakistan": (30.0, 70.0),
    "Bangladesh": (24.0, 90.0),
    "Egypt": (26.0, 30.0),
    "Sudan": (15.0, 30.0),
    "Vietnam": (14.0, 108.0),
    "Thailand": (15.0, 101.0),
    "Ethiopia": (9.0, 40.0),
    "United Kingdom": (54.0, -2.0),
    "New Zealand": (-41.0, 174.0),
}

# Cities given as boxes (min_lat, max_lat, min_lon, max_lon).
CITY_BOXES = {
    "Los Angeles": (33.55, 34.55, -118.75, -117.75),
    "Edmonton": (53.05, 54.05, -113.99, -112.99),
    "Miami": (25.26, 26.26, -80.69, -79.69),
    "Houston": (29.26, 30.26, -95.87, -94.87),
    "Phoenix": (32.95, 33.95, -112.57, -111.57),
    "Seattle": (47.11, 48.11, -122.83, -121.83),
    "Hamburg": (53.05, 54.05, 9.50, 10.50),
    "Denver": (39.24, 40.24, -105.49, -104.49),
    "San Francisco": (37.27, 38.27, -122.92, -121.92),
    "Portland": (45.02, 46.02, -123.18, -122.18),
}

# Pairs of places whose fire counts are compared.
CITY_PAIRS = [
    ("Nairobi", "Vancouver"),
    ("Jakarta", "Rome"),
    ("Cairo", "Buenos Aires"),
    ("Mumbai", "Chicago"),
    ("Lima", "Tokyo"),
    ("Kinshasa", "Berlin"),
    ("Bangkok", "Toronto"),
    ("Accra", "Sydney"),
    ("Mexico City", "Moscow"),
    ("Tehran", "Cape Town"),
]
COUNTRY_PAIRS = [
    ("India", "China"),
    ("Brazil", "Argentina"),
    ("Australia", "Indonesia"),
    ("United States", "Canada"),
    ("Russia", "South Africa"),
    ("Mexico", "Brazil"),
    ("Turkey", "Greece"),
    ("Nigeria", "Kenya"),
    ("Saudi Arabia", "Iran"),
    ("Spain", "Italy"),
    ("France", "Germany"),
    ("Argentina", "Chile"),
    ("India", "Indonesia"),
    ("Pakistan", "Bangladesh"),
    ("Egypt", "Sudan"),
    ("Vietnam", "Thailand"),
    ("Ethiopia", "Kenya"),
    ("United Kingdom", "France"),
    ("Nigeria", "South Africa"),
    ("Australia", "New Zealand"),
]


def places(spark: SparkSession) -> DataFrame:
    """``place, kind, lat, lon`` for the cities and countries above."""
    rows = [(name, "city", lat, lon) for name, (lat, lon) in CITIES.items()]
    rows += [(name, "country", lat, lon) for name, (lat, lon) in COUNTRIES.items()]
    return local_rows(spark, rows, "place string, kind string, lat double, lon double")


def city_boxes(spark: SparkSession) -> DataFrame:
    """``place, min_lat, max_lat, min_lon, max_lon`` for the cities given as boxes."""
    rows = [(name, *box) for name, box in CITY_BOXES.items()]
    return local_rows(
        spark, rows, "place string, min_lat double, max_lat double, min_lon double, max_lon double"
    )


def pairs(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``pair_id, place_a, place_b`` in the given order."""
    return local_rows(
        spark,
        [(i, a, b) for i, (a, b) in enumerate(rows, 1)],
        "pair_id int, place_a string, place_b string",
    )

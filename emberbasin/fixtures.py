"""Tables of the two datasets' shapes, derived from the driver's Parquet tables.

Each is one SQL text for both engines; the few expressions that differ are slots.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 31)
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPARK = {
    "S": "STRING",
    "two": "format_string('%.2f', {0})",
    "age": "timestampdiff(HOUR, ts, TIMESTAMP_NTZ '2024-01-31 00:00:00')",
    "seconds": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
    "millis": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
}
DUCK = {
    "S": "VARCHAR",
    "two": "printf('%.2f', {0})",
    "age": "date_sub('hour', ts, TIMESTAMP '2024-01-31 00:00:00')",
    "seconds": "epoch_us(ts) // 1000000",
    "millis": "epoch_us(ts) // 1000",
}

# Country names for the nation keys, so that the country questions find rows.
NATION_NAMES = [
    "India", "China", "Brazil", "Argentina", "Australia", "Indonesia", "United States", "Canada",
    "South Africa", "Mexico", "Saudi Arabia", "Iran", "Spain", "Italy", "France", "Germany",
    "Egypt", "Sudan", "Kenya", "Ethiopia", "Japan", "Pakistan", "Peru", "United Kingdom", "Nigeria",
]

_COUNTRY = (
    "CASE {key} "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(NATION_NAMES))
    + " END"
)

_POSITIONS = """
      CAST((event_id*7919) % 18001 AS DOUBLE)/CAST(100 AS DOUBLE) - 90 AS lat,
      CAST((event_id*104729) % 36001 AS DOUBLE)/CAST(100 AS DOUBLE) - 180 AS lon,
      CASE user_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'N20' ELSE 'N21' END AS satellite,
      CASE event_type WHEN 'error' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'nominal' END AS confidence,
      CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS day_night
"""


def _month_columns() -> str:
    parts = []
    for month in range(1, 13):
        key = f"month(o_orderdate) = {month}"
        score = f"max(CASE WHEN {key} THEN CAST(o_orderkey % 61 AS DOUBLE)/10 END)"
        parts.append(f"{score} AS bws_{month:02d}_score")
    for month in (1, 2):
        key = f"month(o_orderdate) = {month}"
        parts.append(
            f"coalesce(max(CASE WHEN {key} THEN o_totalprice/1000 END), -9999) AS bws_{month:02d}_raw"
        )
        parts.append(
            f"max(CASE WHEN {key} THEN CAST(o_orderkey % 6 AS INT) - 1 END) AS bws_{month:02d}_cat"
        )
        parts.append(f"min(CASE WHEN {key} THEN o_orderpriority END) AS bws_{month:02d}_label")
        parts.append(
            f"max(CASE WHEN {key} THEN CAST(o_orderkey % 53 AS DOUBLE)/10 END) AS iav_{month:02d}_score"
        )
    return ",\n       ".join(parts)


TEMPLATES = {
    # Cleaned detections, 'low' rows left in so that a load has something to remove.
    "fires": f"""
SELECT md5(concat_ws('_', <two:lat>, <two:lon>, CAST(CAST(ts AS DATE) AS <S>), CAST(user_id AS <S>), satellite)) AS uid,
       lat AS latitude, lon AS longitude,
       300 + value/10 AS brightness_temp_i4, 280 + value/20 AS brightness_temp_i5, value AS frp_mw,
       ts AS acquisition_timestamp, satellite, '2.0NRT' AS version, confidence, day_night,
       CAST(<age> AS DOUBLE) AS hours_old
FROM (SELECT *, {_POSITIONS} FROM events) e
""",
    # The raw feed: seconds and milliseconds, bad and missing times, and every seventh row twice.
    "feed": f"""
SELECT event_id AS OBJECTID, lat AS latitude, lon AS longitude, 300 + value/10 AS bright_ti4,
       280 + value/20 AS bright_ti5, value AS frp, CAST(CAST(ts AS DATE) AS <S>) AS acq_date,
       CASE WHEN event_id % 19 = 0 THEN 'bad' WHEN event_id % 23 = 0 THEN NULL
            WHEN event_id % 2 = 0 THEN CAST(<seconds> AS <S>) ELSE CAST(<millis> AS <S>) END AS acq_time,
       confidence, satellite, day_night AS daynight, '2.0NRT' AS version,
       CAST(<age> AS DOUBLE) AS hours_old
FROM (SELECT *, {_POSITIONS} FROM events UNION ALL SELECT *, {_POSITIONS} FROM events WHERE event_id % 7 = 0) e
""",
    # Fill markers on every 17th key, text fills on every 11th.
    "baseline": f"""
SELECT c_custkey + 10000 AS aq30_id, c_nationkey AS pfaf_id, {_COUNTRY.format(key="n_nationkey")} AS name_0,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_mktsegment END AS name_1,
       concat('N', CAST(n_nationkey AS <S>)) AS gid_0, CAST(c_custkey % 97 AS DOUBLE) AS area_km2,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(-9999 AS DOUBLE) ELSE c_acctbal/1000 END AS bws_raw,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(c_custkey % 51 AS DOUBLE)/10 END AS bws_score,
       CAST((c_custkey*3) % 51 AS DOUBLE)/10 AS rfr_score, CAST((c_custkey*5) % 51 AS DOUBLE)/10 AS drr_score,
       CAST((c_custkey*11) % 51 AS DOUBLE)/10 AS sev_score, CAST((c_custkey*7) % 51 AS DOUBLE)/10 AS iav_score,
       c_acctbal/500 AS gtd_raw, CAST((c_custkey*13) % 51 AS DOUBLE)/10 AS w_awr_def_tot_score,
       CAST(c_custkey % 6 AS INT) - 1 AS bws_cat,
       CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 3 = 0 THEN 'High (40-80%)' ELSE 'Low (<10%)' END AS bws_label,
       CASE WHEN c_custkey % 20 = 0 THEN c_acctbal END AS gtd_score
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    # Fill markers on every 13th key.
    "future": """
SELECT s_suppkey AS fid, s_nationkey AS pfaf_id,
       CASE WHEN s_suppkey % 13 = 0 THEN CAST(9999 AS DOUBLE) ELSE s_acctbal/2000 END AS bau30_ws_x_r,
       s_acctbal/1500 AS bau50_ws_x_r, CAST(s_suppkey % 51 AS DOUBLE)/10 AS bau50_iv_x_r,
       CASE WHEN s_suppkey % 13 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(s_suppkey % 6 AS DOUBLE) END AS bau30_ws_x_s,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'High' ELSE 'Low' END AS bau30_ws_x_l,
       CAST(s_suppkey % 5 AS INT) AS bau30_ws_x_c
FROM supplier
""",
    # Basins of every fifth key have a second name, the basin of key 7 has none.
    "lookup": """
SELECT n_nationkey AS pfaf_id, r_name AS region_name
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7
UNION ALL
SELECT n_nationkey AS pfaf_id, concat(r_name, ' 2') AS region_name
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0
""",
    # Country to continent, with blanks to trim.
    "continents": f"""
SELECT concat(' ', {_COUNTRY.format(key="n_nationkey")}, ' ') AS country, concat(r_name, '  ') AS continent
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
    # One row per customer with orders; scores reach 6.0.
    "monthly": f"""
SELECT CAST(o_custkey + 10000 AS INT) AS pfaf_id,
       {_month_columns()}
FROM orders GROUP BY o_custkey
""",
    # Boxes of varied size around positions given by the supplier key.
    "boxes": """
SELECT s_name AS place, lat - half AS min_lat, lat + half AS max_lat, lon - 2*half AS min_lon, lon + 2*half AS max_lon
FROM (SELECT s_name, CAST((s_suppkey*37) % 170 AS DOUBLE) - 85 AS lat,
             CAST((s_suppkey*101) % 350 AS DOUBLE) - 175 AS lon,
             CAST(1 + s_suppkey % 4 AS DOUBLE) AS half
      FROM supplier) s
""",
    # Places that people ask about: country names in odd case, some unknown.
    "requests": f"""
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 9 = 0 THEN concat('Nowhere ', CAST(c_custkey % 4 AS <S>))
            WHEN c_custkey % 2 = 0 THEN upper({_COUNTRY.format(key="c_nationkey")})
            ELSE concat({_COUNTRY.format(key="c_nationkey")}, ' ') END AS place
FROM customer
""",
    # Questions: conversation turns with a place and a topic in some of them.
    "questions": f"""
SELECT conv_id, turn,
       concat(text, CASE conv_id % 5 WHEN 0 THEN concat(' How many Wildfires burn near ', {_COUNTRY.format(key="turn")}, '?')
                    WHEN 1 THEN ' Is the Groundwater falling in South Africa area'
                    WHEN 2 THEN ' Any smoke over the Rivers around Lima, Peru'
                    WHEN 3 THEN ' at NOON.' ELSE '' END) AS text
FROM conversations
""",
}


def _fill(template: str, slots: Mapping[str, str]) -> str:
    for name in ("S", "age", "seconds", "millis"):
        template = template.replace(f"<{name}>", slots[name])
    for column in ("lat", "lon"):
        template = template.replace(f"<two:{column}>", slots["two"].format(column))
    return template


_frames: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame analysed once per application, as a view in a catalog would be."""
    full = (spark.sparkContext.applicationId, id(spark), *key)
    if full not in _frames:
        _frames[full] = make()
    return _frames[full]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is."""
    return _once(spark, (sf_dir, name), lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    return _once(
        spark, (sf_dir, name), lambda: _derive(spark, sf_dir, name)
    )


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _fill(TEMPLATES[name], SPARK)
    used = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text)) & set(TABLES))
    frames = {t: table(spark, sf_dir, t) for t in used}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(text, **frames)


def duck(*names: str) -> str:
    """``WITH`` clause that defines derived tables for DuckDB."""
    return "WITH " + ",\n".join(f"{name} AS ({_fill(TEMPLATES[name], DUCK)})" for name in names)

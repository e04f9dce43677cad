"""Fire counts, lists, statistics, emissions and free SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.fixtures import AS_OF, duck, fixture
from emberbasin.functions.columns import age_hours, iso_text, log_power, marker_size
from emberbasin.functions.filters import ntz
from emberbasin.operators import emissions, fires
from emberbasin.operators.freesql import run_select
from emberbasin.registry.base import query, rounded
from emberbasin.streaming.rolling import rolling_emissions, sliding_emissions

WITH = duck("fires")
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fires")


@query(
    f"""{WITH} SELECT count(*) AS fire_count FROM fires
    WHERE confidence IN ('nominal', 'high') AND frp_mw BETWEEN 20 AND 200 AND satellite = 'N20'
      AND acquisition_timestamp >= '2024-01-05 00:00:00' AND hours_old <= 500"""
)
def fires_count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {
        "confidence": ["nominal", "high"],
        "frp_mw": {"min": 20, "max": 200},
        "satellite": "N20",
        "acquisition_timestamp": {"min": "2024-01-05 00:00:00"},
        "hours_old": {"max": 500},
        "day_night": {},
    }
    return fires.count_fires(_fires(spark, sf_dir), filters)


@query(f"{WITH} SELECT count(*) AS fire_count FROM fires WHERE false")
def fires_count_empty_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_fires(_fires(spark, sf_dir), {"satellite": []})


@query(f"{WITH} SELECT count(*) AS fire_count FROM fires WHERE satellite = NULL")
def fires_count_null_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_fires(_fires(spark, sf_dir), {"satellite": None})


@query(
    f"""{WITH}, g AS (SELECT satellite, confidence, count(*) AS fire_count FROM fires
      WHERE frp_mw >= 10 GROUP BY ALL)
    SELECT *, CAST((SELECT sum(fire_count) FROM g) AS BIGINT) AS total_count FROM g
    ORDER BY fire_count DESC"""
)
def fires_count_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_fires(
        _fires(spark, sf_dir), {"frp_mw": {"min": 10}}, ["satellite", "confidence"]
    )


@query(
    f"""{WITH} SELECT count(*) AS fire_count, '2024-01-10' AS query_date,
      '2024-01-10 00:00:00' AS range_start, '2024-01-10 23:59:59' AS range_end
    FROM fires WHERE confidence = 'nominal' AND acquisition_timestamp
      BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59'"""
)
def fires_count_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_on_date(_fires(spark, sf_dir), "2024-01-10", "nominal")


@query(
    f"""{WITH}, g AS (SELECT day_night, count(*) AS fire_count FROM fires
      WHERE satellite = 'N21' AND acquisition_timestamp
        BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59' GROUP BY 1)
    SELECT *, CAST((SELECT sum(fire_count) FROM g) AS BIGINT) AS total_count,
      '2024-01-10' AS query_date, '2024-01-10 00:00:00' AS range_start,
      '2024-01-10 23:59:59' AS range_end FROM g"""
)
def fires_count_on_date_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_on_date(
        _fires(spark, sf_dir), "2024-01-10", group_by=["day_night"], filters={"satellite": "N21"}
    )


@query(
    f"""{WITH} SELECT count(*) AS fire_count, '2024-01-08' AS start_date, '2024-01-14' AS end_date,
      7 AS days_included, '2024-01-08 00:00:00' AS range_start, '2024-01-14 23:59:59' AS range_end
    FROM fires WHERE acquisition_timestamp
      BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'"""
)
def fires_count_between_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_between(_fires(spark, sf_dir), "2024-01-08", "2024-01-14")


@query(
    f"""{WITH} SELECT count(*) AS fire_count, CAST(2.5 AS DOUBLE) AS days_back,
      '2024-01-28 12:00:00' AS cutoff
    FROM fires WHERE acquisition_timestamp >= TIMESTAMP '2024-01-28 12:00:00'
      AND confidence = 'high'"""
)
def fires_count_last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_last_days(_fires(spark, sf_dir), 2.5, AS_OF, "high")


WINDOW_HOURS = [168, 24, 48, 72, 12, 120, 36, 336, 6]


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT 'last {h} hours' AS question, count(*) AS fire_count FROM fires
        WHERE acquisition_timestamp >= {AS_OF_SQL} - INTERVAL '{h} hours'"""
        for h in WINDOW_HOURS
    )
)
def fires_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_windows(_fires(spark, sf_dir), WINDOW_HOURS, AS_OF)


THRESHOLDS = [20, 50, 30, 100, 40, 60, 25, 75, 35, 45]


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT 'frp > {t}' AS question, count(*) AS fire_count FROM fires
        WHERE frp_mw IS NOT NULL AND frp_mw > {t}"""
        for t in THRESHOLDS
    )
)
def fires_count_power_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_above_power(_fires(spark, sf_dir), THRESHOLDS)


CONFIDENCE_WINDOWS = [
    ("high", 24), ("nominal", 48), ("high", 168), ("nominal", 72), ("high", 72),
    ("nominal", 12), ("high", 120), ("nominal", 36), ("high", 48), ("nominal", 6),
]


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT '{level} last {h} hours' AS question, count(*) AS fire_count FROM fires
        WHERE confidence = '{level}'
          AND acquisition_timestamp >= {AS_OF_SQL} - INTERVAL '{h} hours'"""
        for level, h in CONFIDENCE_WINDOWS
    )
)
def fires_count_confidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_confidence_windows(_fires(spark, sf_dir), CONFIDENCE_WINDOWS, AS_OF)


DAYS = [f"2024-01-{d}" for d in range(18, 25)]
RANGES = [
    ("2024-01-18", "2024-01-20"), ("2024-01-20", "2024-01-22"), ("2024-01-18", "2024-01-24"),
]


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        [
            f"""SELECT '{d}' AS question, count(*) AS fire_count FROM fires
            WHERE CAST(acquisition_timestamp AS DATE) = DATE '{d}'"""
            for d in DAYS
        ]
        + [
            f"""SELECT '{a} to {b}' AS question, count(*) AS fire_count FROM fires
            WHERE CAST(acquisition_timestamp AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'"""
            for a, b in RANGES
        ]
    )
)
def fires_count_days_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.count_days(_fires(spark, sf_dir), DAYS, RANGES)


@query(
    f"""{WITH} SELECT count(*) AS total_detections, round(avg(frp_mw), 6) AS avg_frp,
      max(frp_mw) AS max_frp, min(frp_mw) AS min_frp,
      round(avg(brightness_temp_i4), 6) AS avg_brightness,
      count(CASE WHEN confidence = 'nominal' THEN 1 END) AS nominal_confidence,
      count(CASE WHEN confidence = 'low' THEN 1 END) AS low_confidence,
      count(CASE WHEN day_night = 'D' THEN 1 END) AS day_detections,
      count(CASE WHEN day_night = 'N' THEN 1 END) AS night_detections
    FROM fires WHERE hours_old <= 72"""
)
def fires_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fires.fire_statistics(_fires(spark, sf_dir), 72), "avg_frp", "avg_brightness")


@query(
    f"""{WITH} SELECT min(acquisition_timestamp) AS min_date,
      max(acquisition_timestamp) AS max_date FROM fires"""
)
def fires_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.time_range(_fires(spark, sf_dir))


@query(
    f"""{duck('feed')} SELECT *, count(*) AS dup_count FROM feed GROUP BY ALL HAVING count(*) > 1"""
)
def fires_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.duplicate_rows(fixture(spark, sf_dir, "feed"))


@query(
    f"""{WITH} SELECT latitude, longitude, brightness_temp_i4, brightness_temp_i5, frp_mw,
      confidence, acquisition_timestamp, hours_old, satellite
    FROM fires WHERE hours_old <= 24 AND confidence = 'nominal'
    ORDER BY acquisition_timestamp DESC, uid LIMIT 100"""
)
def fires_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.recent_fires(_fires(spark, sf_dir))


@query(
    f"""{WITH} SELECT latitude, longitude, brightness_temp_i4, frp_mw, confidence,
      acquisition_timestamp, hours_old
    FROM fires WHERE latitude BETWEEN -35 AND 10 AND longitude BETWEEN -80 AND -35
      AND CAST(acquisition_timestamp AS DATE) >= '2024-01-10'
      AND CAST(acquisition_timestamp AS DATE) <= '2024-01-20'
    ORDER BY acquisition_timestamp DESC, uid LIMIT 100"""
)
def fires_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.fires_in_box(
        _fires(spark, sf_dir), -35, 10, -80, -35, "2024-01-10", "2024-01-20"
    )


@query(
    f"""{WITH} SELECT latitude, longitude, frp_mw, brightness_temp_i4, brightness_temp_i5,
      confidence, acquisition_timestamp, hours_old
    FROM fires WHERE frp_mw >= 20 AND hours_old <= 72 ORDER BY frp_mw DESC, uid LIMIT 50"""
)
def fires_high_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.intense_fires(_fires(spark, sf_dir))


@query(
    f"""{WITH} SELECT latitude, longitude, brightness_temp_i4, frp_mw, confidence,
      acquisition_timestamp, hours_old, satellite
    FROM fires WHERE CAST(acquisition_timestamp AS DATE) BETWEEN '2024-01-12' AND '2024-01-15'
      AND confidence = 'high'
    ORDER BY acquisition_timestamp DESC, uid LIMIT 100"""
)
def fires_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.fires_by_date(_fires(spark, sf_dir), "2024-01-12", "2024-01-15", "high")


@query(
    f"""{WITH} SELECT uid, frp_mw, satellite FROM fires
    WHERE day_night = 'N' AND frp_mw BETWEEN 100 AND 300"""
)
def fires_rows_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"day_night": "N", "frp_mw": {"min": 100, "max": 300}}
    return fires.fire_rows(_fires(spark, sf_dir), filters, ["uid", "frp_mw", "satellite"], 0)


@query(
    f"""{WITH} SELECT uid, latitude, longitude, confidence FROM fires
    WHERE confidence IN ('high', 'low') ORDER BY uid LIMIT 1000"""
)
def fires_rows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.capped_fire_rows(
        _fires(spark, sf_dir),
        {"confidence": ["high", "low"]},
        ["uid", "latitude", "longitude", "confidence"],
        5000,
        ["uid"],
    )


@query(
    f"""{WITH} SELECT uid, round(CASE WHEN frp_mw IS NOT NULL THEN log10(greatest(frp_mw, 1)) END, 9) AS log_frp,
      CASE WHEN frp_mw IS NOT NULL THEN least(frp_mw, 500)/4 END AS marker,
      CAST(date_sub('hour', acquisition_timestamp, {AS_OF_SQL}) AS DOUBLE) AS age,
      strftime(acquisition_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS acquired
    FROM fires"""
)
def fires_derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir).select(
        "uid",
        F.round(log_power(F.col("frp_mw")), 9).alias("log_frp"),
        marker_size(F.col("frp_mw")).alias("marker"),
        age_hours(F.col("acquisition_timestamp"), ntz(AS_OF)).alias("age"),
        iso_text(F.col("acquisition_timestamp")).alias("acquired"),
    )


MASSES = """
  round_even(e * 100, 0)/100 AS total_energy_mj, round_even(e*1.37 * 100, 0)/100 AS co2_kg,
  round_even(e*0.0048 * 10000, 0)/10000 AS ch4_kg, round_even(e*0.0002 * 10000, 0)/10000 AS n2o_kg,
  round_even(e*0.063 * 100, 0)/100 AS co_kg,
  round_even((e*1.37 + e*0.0048*28 + e*0.0002*265) * 100, 0)/100 AS total_co2e_kg,
  round_even((e*1.37 + e*0.0048*28 + e*0.0002*265)/1000 * 10000, 0)/10000 AS total_co2e_tonnes
"""
for _factor in ("1.37", "0.0048", "0.0002", "0.063", "28", "265"):
    MASSES = MASSES.replace(f"*{_factor}", f"*CAST({_factor} AS DOUBLE)")
MASS_CTE = f""", masses AS (SELECT *, hours_old AS duration_hours, {MASSES}
  FROM (SELECT *, frp_mw*hours_old*3600 AS e FROM fires
        WHERE frp_mw IS NOT NULL AND hours_old IS NOT NULL) f)"""
TOTALS = """count(*) AS fire_count,
  round(coalesce(sum(total_energy_mj), 0), 0) AS total_energy_mj,
  round(coalesce(sum(co2_kg), 0), 0) AS co2_kg, round(coalesce(sum(ch4_kg), 0), 0) AS ch4_kg,
  round(coalesce(sum(n2o_kg), 0), 0) AS n2o_kg, round(coalesce(sum(co_kg), 0), 0) AS co_kg,
  round(coalesce(sum(total_co2e_kg), 0), 0) AS total_co2e_kg,
  round(avg(total_co2e_kg), 0) AS co2e_kg_per_fire"""


@query(
    f"""{WITH}{MASS_CTE} SELECT uid, frp_mw, duration_hours, total_energy_mj, co2_kg, ch4_kg,
      n2o_kg, co_kg, total_co2e_kg, total_co2e_tonnes FROM masses"""
)
def emissions_per_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emissions.with_emissions(_fires(spark, sf_dir)).select(
        "uid", "frp_mw", "duration_hours", "total_energy_mj", "co2_kg", "ch4_kg", "n2o_kg",
        "co_kg", "total_co2e_kg", "total_co2e_tonnes",
    )


@query(
    f"""{WITH}{MASS_CTE} SELECT {TOTALS} FROM masses
    WHERE latitude BETWEEN 30 AND 42 AND longitude BETWEEN -126 AND -112
      AND CAST(acquisition_timestamp AS DATE) >= '2024-01-20'
      AND CAST(acquisition_timestamp AS DATE) <= '2024-01-30'"""
)
def emissions_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        emissions.box_emissions(
            _fires(spark, sf_dir), 30, 42, -126, -112, "2024-01-20", "2024-01-30"
        ),
        places=0,
    )


@query(f"{WITH}{MASS_CTE} SELECT {TOTALS} FROM masses WHERE hours_old <= 24")
def emissions_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(emissions.recent_emissions(_fires(spark, sf_dir), 24), places=0)


@query(
    f"""{WITH}{MASS_CTE} SELECT time_bucket(INTERVAL '1 hour', acquisition_timestamp) AS window_start,
      time_bucket(INTERVAL '1 hour', acquisition_timestamp) + INTERVAL '1 hour' AS window_end,
      confidence, count(*) AS fire_count, round(sum(total_energy_mj), 0) AS total_energy_mj,
      round(sum(co2_kg), 0) AS co2_kg, round(sum(total_co2e_kg), 0) AS total_co2e_kg
    FROM masses GROUP BY ALL"""
)
def emissions_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_emissions(_fires(spark, sf_dir)), places=0)


@query(
    f"""{WITH}{MASS_CTE}, hourly AS (
      SELECT time_bucket(INTERVAL '1 hour', acquisition_timestamp) AS h, confidence, count(*) AS n, sum(total_energy_mj) AS e,
        sum(co2_kg) AS c, sum(total_co2e_kg) AS q FROM masses GROUP BY ALL
    ), ends AS (SELECT min(h) AS low, max(h) + INTERVAL '23 hours' AS high FROM hourly
    ), grid AS (
      SELECT h, confidence FROM (SELECT unnest(generate_series(low, high, INTERVAL '1 hour')) AS h FROM ends), (SELECT DISTINCT confidence FROM hourly)
    ), spans AS (
      SELECT g.h, g.confidence, sum(n) OVER w AS n, sum(e) OVER w AS e, sum(c) OVER w AS c, sum(q) OVER w AS q
      FROM grid g LEFT JOIN hourly USING (h, confidence)
      WINDOW w AS (PARTITION BY g.confidence ORDER BY g.h RANGE BETWEEN INTERVAL '23 hours' PRECEDING AND CURRENT ROW)
    )
    SELECT h - INTERVAL '23 hours' AS window_start, h + INTERVAL '1 hour' AS window_end, confidence, n::BIGINT AS fire_count,
      round(e + 0.003, 0) AS total_energy_mj, round(c + 0.003, 0) AS co2_kg, round(q + 0.003, 0) AS total_co2e_kg
    FROM spans WHERE n > 0"""
)
def emissions_last_day_each_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sums of hundredths: a little more than they are, so that none lies on the edge of rounding.
    found = sliding_emissions(_fires(spark, sf_dir))
    return rounded(found.withColumns({c: F.col(c) + 0.003 for c in ("total_energy_mj", "co2_kg", "total_co2e_kg")}), places=0)


FREE_SQL = """
    WITH ranked AS (
      SELECT satellite, uid, frp_mw,
             rank() OVER (PARTITION BY satellite ORDER BY frp_mw DESC, uid) AS place
      FROM {table} WHERE confidence <> 'low')
    SELECT satellite, uid, frp_mw, CAST(place AS INT) AS place FROM ranked WHERE place <= 5
    ORDER BY satellite, place"""


@query(f"{WITH} SELECT * FROM ({FREE_SQL.format(table='fires')})")
def fires_free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"VIIRS_Thermal_Records": _fires(spark, sf_dir)}
    return run_select(spark, FREE_SQL.format(table="VIIRS_Thermal_Records"), tables)

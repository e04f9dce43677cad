"""Country questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.fixtures import duck, fixture, table
from emberbasin.operators import countries
from emberbasin.operators.cleaning import clean_baseline_annual, null_fills
from emberbasin.registry.base import query, rounded

MARKERS = "IN (-9999, 9999)"
WITH = f"""{duck('baseline', 'future', 'continents')},
clean AS (SELECT * REPLACE (CASE WHEN bws_raw {MARKERS} THEN NULL ELSE bws_raw END AS bws_raw,
  CASE WHEN bws_score {MARKERS} THEN NULL ELSE bws_score END AS bws_score) FROM baseline),
later AS (SELECT * REPLACE (CASE WHEN bau30_ws_x_r {MARKERS} THEN NULL ELSE bau30_ws_x_r END AS bau30_ws_x_r)
  FROM future),
b AS (SELECT name_0 AS country, avg(bws_raw) AS bws_raw, avg(bws_score) AS bws_score,
  avg(rfr_score) AS rfr_score, avg(drr_score) AS drr_score, avg(sev_score) AS sev_score,
  avg(iav_score) AS iav_score, avg(gtd_raw) AS gtd_raw,
  avg(w_awr_def_tot_score) AS overall_risk_score FROM clean GROUP BY 1),
m AS (SELECT DISTINCT CAST(pfaf_id AS BIGINT) AS pfaf, name_0 AS country FROM clean),
p AS (SELECT CAST(pfaf_id AS BIGINT) AS pfaf, avg(bau30_ws_x_r) AS ws_2030,
  avg(bau50_ws_x_r) AS ws_2050, avg(bau50_iv_x_r) AS iv_2050 FROM later GROUP BY 1),
f AS (SELECT country, avg(ws_2030) AS ws_2030, avg(ws_2050) AS ws_2050, avg(iv_2050) AS iv_2050
  FROM p JOIN m USING (pfaf) GROUP BY 1),
both_ AS (SELECT * FROM b JOIN f USING (country)),
any_ AS (SELECT * FROM b FULL JOIN f USING (country)),
cc AS (SELECT trim(country) AS country, trim(continent) AS continent FROM continents)"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_baseline_annual(fixture(spark, sf_dir, "baseline"))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.country_baseline(_baseline(spark, sf_dir))


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    future = null_fills(fixture(spark, sf_dir, "future"), ["bau30_ws_x_r"])
    return countries.country_future(future, _baseline(spark, sf_dir))


def _any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each country with what is known of it: one without projections keeps its present answers."""
    return _now(spark, sf_dir).join(_later(spark, sf_dir), "country", "full")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _now(spark, sf_dir).join(_later(spark, sf_dir), "country")


@query(
    f"""{WITH} SELECT country, {', '.join(f'round({c}, 6) AS {c}' for c in countries.BASELINE_METRICS)}
    FROM b"""
)
def country_baseline_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_now(spark, sf_dir))


@query(
    f"""{WITH} SELECT country, {', '.join(f'round({c}, 6) AS {c}' for c in countries.FUTURE_METRICS)}
    FROM f"""
)
def country_future_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_later(spark, sf_dir))


@query(f"{WITH} SELECT * FROM m")
def country_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.basin_countries(_baseline(spark, sf_dir))


@query(
    f"""{WITH} SELECT round(avg(gtd_raw), 4) AS mean_value FROM b JOIN cc USING (country)
    WHERE continent = 'AFRICA'"""
)
def country_continent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = countries.continents(fixture(spark, sf_dir, "continents"))
    return countries.continent_mean(_now(spark, sf_dir), mapping, "AFRICA", "gtd_raw")


@query(
    f"""{WITH} SELECT round(avg(drr_score), 4) AS mean_value FROM b
    WHERE country IN ({', '.join(f"'{c}'" for c in countries.MIDDLE_EAST)})"""
)
def country_list_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.list_mean(_now(spark, sf_dir), countries.MIDDLE_EAST, "drr_score")


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT '{question}' AS question, country, round({metric}, 4) AS value FROM any_
        WHERE country = '{country}'"""
        for question, metric, country in countries.COUNTRY_QUESTIONS
    )
)
def country_single_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.country_values(_any(spark, sf_dir), countries.COUNTRY_QUESTIONS)


@query(
    f"""{WITH} SELECT country, round(bws_score, 4) AS base, round(ws_2050, 4) AS future,
      round(ws_2050 - bws_score, 4) AS change FROM both_ WHERE country IN ('India', 'Germany')"""
)
def country_projected_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.projected_change(
        _both(spark, sf_dir), "bws_score", "ws_2050", ["India", "Germany"]
    )


@query(
    f"""{WITH} SELECT country, round(((ws_2050 - ws_2030)/ws_2030)*100, 2) AS demand_increase_pct
    FROM f"""
)
def country_demand_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.demand_increase(_later(spark, sf_dir))


@query(
    f"""{WITH} SELECT country, round(iav_score - iv_2050, 4) AS improvement FROM both_
    WHERE iv_2050 < iav_score ORDER BY improvement DESC, country LIMIT 15"""
)
def country_drought_improving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.largest_drop(_both(spark, sf_dir), "iav_score", "iv_2050")


@query(
    f"""{WITH}, r AS (SELECT name_0 AS country, avg(rfr_score) AS before FROM baseline GROUP BY 1),
    l AS (SELECT name_0 AS country, avg(bau50_rf_x_r) AS after FROM (
      SELECT bau50_ws_x_r AS bau50_rf_x_r, n.country AS name_0 FROM future
      JOIN (SELECT DISTINCT pfaf_id, name_0 AS country FROM baseline) n USING (pfaf_id)) GROUP BY 1)
    SELECT country, round(after - before, 4) AS increase FROM r JOIN l USING (country)
    WHERE after > before ORDER BY increase DESC, country LIMIT 15"""
)
def country_flood_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = _baseline(spark, sf_dir)
    named_basins = countries.basin_countries(baseline).withColumnsRenamed(
        {"pfaf": "pfaf_id", "country": "name_0"}
    )
    future = (
        fixture(spark, sf_dir, "future")
        .withColumnRenamed("bau50_ws_x_r", "bau50_rf_x_r")
        .join(named_basins, "pfaf_id")
    )
    return countries.flood_rise(baseline, future)


@query(
    f"{WITH} "
    + " UNION ALL ".join(
        f"""SELECT {number} AS number, '{question}' AS question, country,
          round({metric}, 4) AS value FROM any_ WHERE country IN ('{one}', '{two}')"""
        for number, (question, metric, one, two) in enumerate(countries.COUNTRY_COMPARISONS, 1)
    )
)
def country_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.compare_countries(_any(spark, sf_dir), countries.COUNTRY_COMPARISONS)


@query("SELECT n_nationkey, trim(n_name) AS n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
def country_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return nations.where(F.col("n_name").ilike("nation_1%")).select(
        "n_nationkey", F.trim("n_name").alias("n_name")
    )

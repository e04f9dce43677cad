"""Water-risk rows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberbasin.fixtures import duck, fixture
from emberbasin.operators import water
from emberbasin.registry.base import query, rounded

WITH = duck("baseline", "lookup", "future")
FROM = "FROM baseline t LEFT JOIN lookup rl ON t.pfaf_id = rl.pfaf_id"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf_dir, "baseline"), fixture(spark, sf_dir, "lookup")


@query(
    f"""{WITH} SELECT aq30_id, t.pfaf_id, bws_score, rl.region_name {FROM}
    WHERE bws_score BETWEEN 1 AND 4 AND name_1 IN ('BUILDING', 'MACHINERY')"""
)
def water_rows_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    filters = {"bws_score": {"min": 1, "max": 4}, "name_1": ["BUILDING", "MACHINERY"]}
    columns = ["aq30_id", "pfaf_id", "region_name", "bws_score"]
    return water.water_rows(baseline, lookup, filters, columns)


@query(
    f"""{WITH} SELECT aq30_id, gtd_raw, rl.region_name {FROM}
    WHERE rl.region_name = 'ASIA' AND gtd_raw >= 10 ORDER BY aq30_id LIMIT 10"""
)
def water_rows_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    filters = {"region_name": "ASIA", "gtd_raw": {"min": 10}}
    return water.water_rows(
        baseline, lookup, filters, ["aq30_id", "gtd_raw"], water.TOOL_ROWS, ["aq30_id"]
    )


@query(
    f"""{WITH} SELECT aq30_id, one.region_name FROM baseline t
    LEFT JOIN (SELECT pfaf_id, min(region_name) AS region_name FROM lookup GROUP BY 1) one
      ON t.pfaf_id = one.pfaf_id"""
)
def water_rows_one_region_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    return water.water_rows(
        baseline, lookup, columns=["aq30_id"], lookup_mode="one_per_key"
    )


@query(f"{WITH} SELECT fid, bau30_ws_x_l FROM future WHERE bau30_ws_x_c <= 2")
def water_rows_without_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.water_rows(
        fixture(spark, sf_dir, "future"),
        filters={"bau30_ws_x_c": {"max": 2}},
        columns=["fid", "bau30_ws_x_l"],
    )


@query(
    f"""{WITH} SELECT t.name_1, rl.region_name, round(avg(t.bws_score), 6) AS avg_bws,
      count(*) AS n, max(gtd_raw) AS max_gtd {FROM}
    WHERE bws_score >= 0 GROUP BY 1, 2 HAVING count(*) > 5 AND avg(t.bws_score) > 1"""
)
def water_aggregate_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    result = water.water_aggregate(
        baseline,
        ["AVG(t.bws_score) AS avg_bws", "COUNT(*) AS n", "MAX(gtd_raw) AS max_gtd"],
        ["name_1", "region_name"],
        {"bws_score": {"min": 0}},
        "COUNT(*) > 5 AND avg_bws > 1",
        lookup,
    )
    return rounded(result, "avg_bws")


@query(
    f"""{WITH} SELECT count(*) AS n, round(sum(gtd_raw), 6) AS total {FROM}
    WHERE rl.region_name IN ('ASIA', 'EUROPE')"""
)
def water_aggregate_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    result = water.water_aggregate(
        baseline,
        ["COUNT(*) AS n", "SUM(gtd_raw) AS total"],
        filters={"region_name": ["ASIA", "EUROPE"]},
        lookup=lookup,
    )
    return rounded(result, "total")


@query(
    f"""{WITH} SELECT bau30_ws_x_c, min(bau50_ws_x_r) AS lowest, count(DISTINCT pfaf_id) AS basins
    FROM future GROUP BY 1"""
)
def water_aggregate_without_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.water_aggregate(
        fixture(spark, sf_dir, "future"),
        ["MIN(bau50_ws_x_r) AS lowest", "COUNT(DISTINCT pfaf_id) AS basins"],
        ["bau30_ws_x_c"],
    )


@query(
    f"""{WITH}, b AS (SELECT t.pfaf_id, bws_score, rl.region_name, 'baseline' AS scenario {FROM}
      WHERE t.pfaf_id = 12 ORDER BY aq30_id LIMIT 10),
    f AS (SELECT t.pfaf_id, bau50_ws_x_r, rl.region_name, 'future' AS scenario
      FROM future t LEFT JOIN lookup rl ON t.pfaf_id = rl.pfaf_id
      WHERE t.pfaf_id = 12 ORDER BY fid LIMIT 10)
    SELECT * FROM b UNION ALL BY NAME SELECT * FROM f"""
)
def water_compare_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, lookup = _tables(spark, sf_dir)
    return water.compare_scenarios(
        baseline,
        fixture(spark, sf_dir, "future"),
        lookup,
        {"filters": {"pfaf_id": 12}, "columns": ["pfaf_id", "bws_score"], "order_by": ["aq30_id"]},
        {"filters": {"pfaf_id": 12}, "columns": ["pfaf_id", "bau50_ws_x_r"], "order_by": ["fid"]},
    )


@query(f"{WITH} SELECT * FROM baseline WHERE gid_0 = 'N3'")
def water_rows_for_region_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, _ = _tables(spark, sf_dir)
    return water.rows_for_region(baseline, "gid_0", "N3", 0)


@query(
    f"""{WITH} SELECT *, name_1 AS region_name
    FROM (SELECT DISTINCT name_0, pfaf_id, name_1, area_km2, gid_0 FROM baseline)
    WHERE name_0 IS NOT NULL AND name_1 IS NOT NULL AND gid_0 IS NOT NULL"""
)
def water_region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.region_lookup(fixture(spark, sf_dir, "baseline"))

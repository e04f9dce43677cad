"""Table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberbasin.fixtures import duck, fixture, table
from emberbasin.functions.columns import log_power
from emberbasin.operators import profiling
from emberbasin.operators.cleaning import clean_baseline_annual
from emberbasin.registry.base import query, rounded
from emberbasin.registry.cleaning import BASELINE_VALUES, marked

WITH = f"""{duck('baseline')}, clean AS (SELECT {marked(BASELINE_VALUES)} FROM baseline)"""
FIRES = duck("fires")
NUMBERS = ["aq30_id", "pfaf_id", "area_km2", *BASELINE_VALUES[:8], "bws_cat", "gtd_score"]
TEXTS = ["name_0", "name_1", "gid_0", "bws_label"]
ALL = [
    "aq30_id", "pfaf_id", "name_0", "name_1", "gid_0", "area_km2", *BASELINE_VALUES[:8],
    "bws_cat", "bws_label", "gtd_score",
]
FIRE_NUMBERS = ["brightness_temp_i4", "brightness_temp_i5", "frp_mw", "hours_old"]


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_baseline_annual(fixture(spark, sf_dir, "baseline"))


def _describe(column: str, source: str) -> str:
    c = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({c}), 6) AS mean,
      round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
      round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
      max({c}) AS max FROM {source}"""


def _each(columns: list[str], text: str) -> str:
    return " UNION ALL ".join(text.replace("<c>", c) for c in columns)


@query(f"{FIRES} " + " UNION ALL ".join(_describe(c, "fires") for c in FIRE_NUMBERS))
def profile_describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profiling.describe_numeric(fixture(spark, sf_dir, "fires"), FIRE_NUMBERS)
    return rounded(described, "mean", "std", "p25", "p50", "p75")


@query(f"{FIRES} " + " UNION ALL ".join(_describe(c, "fires") for c in FIRE_NUMBERS))
def profile_describe_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profiling.describe_numeric(fixture(spark, sf_dir, "fires"), FIRE_NUMBERS, True)
    return rounded(described, "mean", "std", "p25", "p50", "p75")


@query(
    f"""{WITH}, n AS ({" UNION ALL ".join(_describe(c, 'clean') for c in NUMBERS)}),
    v AS ({_each(TEXTS, "SELECT '<c>' AS col, <c> AS value, count(*) AS n FROM clean WHERE <c> IS NOT NULL GROUP BY 2")}),
    t AS (SELECT col AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
      arg_min(value, (-n, value)) AS top, max(n) AS freq FROM v GROUP BY 1)
    SELECT "column", count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
      mean, std, min, p25, p50, p75, max FROM n
    UNION ALL BY NAME SELECT * FROM t"""
)
def profile_describe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profiling.describe_all(_clean(spark, sf_dir))
    return rounded(described, "mean", "std", "p25", "p50", "p75")


@query(
    f"""{WITH}, v AS ({_each(TEXTS, "SELECT '<c>' AS col, <c> AS value, count(*) AS n FROM clean WHERE <c> IS NOT NULL GROUP BY 2")})
    SELECT col AS "column", count(*) OVER (PARTITION BY col) AS unique_count,
      CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS INT) AS place, value, n
    FROM v QUALIFY place <= 10"""
)
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(_clean(spark, sf_dir))


NULLS = """SELECT '<c>' AS "column", count(*) - count(<c>) AS null_count,
  round((count(*) - count(<c>)) / count(*), 6) AS null_fraction,
  round((count(*) - count(<c>)) / count(*) * 100, 6) AS null_percent FROM clean"""


@query(f"{WITH} {_each(ALL, NULLS)}")
def profile_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.null_counts(_clean(spark, sf_dir)))


@query(
    f"""{WITH} SELECT "column", null_count FROM ({_each(ALL, NULLS)})
    ORDER BY null_count DESC, "column" LIMIT 5"""
)
def profile_most_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.most_null(_clean(spark, sf_dir), 5)


@query(
    f"""{duck('feed')}
    SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM feed)) AS duplicate_rows FROM feed"""
)
def profile_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.duplicate_count(fixture(spark, sf_dir, "feed"))


@query("SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.shape(table(spark, sf_dir, "lineitem"))


DISTINCT = """SELECT '<c>' AS "column", count(DISTINCT <c>) AS unique_count FROM clean"""


@query(f"{WITH} {_each(ALL, DISTINCT)}")
def profile_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_counts(_clean(spark, sf_dir))


@query(f"""{WITH} SELECT *, true AS is_close FROM ({_each(ALL, DISTINCT)})""")
def profile_distinct_counts_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact counts, and whether the sketches come within five percent of them."""
    clean = _clean(spark, sf_dir)
    about = profiling.approximate_distinct_counts(clean).withColumnRenamed("unique_count", "about")
    off = F.abs(F.col("about") - F.col("unique_count"))
    return (
        profiling.distinct_counts(clean)
        .join(about, "column")
        .select("column", "unique_count", (off <= F.col("unique_count") * 0.05).alias("is_close"))
    )


FLAGS = f"""{WITH.replace(" FROM baseline)", ", 1 AS one, NULL::DOUBLE AS none FROM baseline)")},
  d AS ({_each([*ALL, "one", "none"], DISTINCT)})"""


@query(
    f"""{FLAGS} SELECT "column", unique_count, unique_count = 1 AS is_constant,
      unique_count = 0 AS is_all_null,
      unique_count / (SELECT count(*) FROM clean) > 0.95 AS is_high_cardinality FROM d"""
)
def profile_cardinality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = _clean(spark, sf_dir).withColumns(
        {"one": F.lit(1), "none": F.lit(None).cast("double")}
    )
    return profiling.cardinality_flags(wider)


@query(
    f"""{WITH} {_each(TEXTS, '''SELECT '<c>' AS "column", count(*) - count(<c>) > 0 AS has_nulls,
      count(*) - count(<c>) AS null_count, count(DISTINCT <c>) AS unique_count, 'string' AS type,
      min(<c>) AS sample_value, false AS clean_name FROM clean''')}"""
)
def profile_column_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _clean(spark, sf_dir).select(*TEXTS)
    return profiling.column_overview(texts).drop("position")


@query(
    f"""{WITH}, nulls AS ({_each(ALL, NULLS)}), d AS ({_each(ALL, DISTINCT)}),
    rows_ AS (SELECT count(*) AS n FROM clean),
    report AS (SELECT 'rows' AS metric, NULL::VARCHAR AS "column", n::DOUBLE AS value FROM rows_
    UNION ALL SELECT 'columns', NULL, {len(ALL)}
    UNION ALL SELECT 'duplicate_rows', NULL, (SELECT n FROM rows_) - count(*) FROM (SELECT DISTINCT * FROM clean)
    UNION ALL SELECT 'missing_values', NULL, sum(null_count) FROM nulls
    UNION ALL SELECT 'columns_with_missing', NULL, count(*) FROM nulls WHERE null_count > 0
    UNION ALL SELECT 'missing_by_column', "column", null_count FROM nulls
    UNION ALL SELECT 'missing_fraction', "column", null_fraction FROM nulls
    UNION ALL SELECT 'all_missing', "column", 1 FROM d WHERE unique_count = 0
    UNION ALL SELECT 'one_unique_value', "column", 1 FROM d WHERE unique_count = 1
    UNION ALL SELECT 'high_cardinality', "column", unique_count FROM d, rows_ WHERE unique_count / n > 0.95)
    SELECT metric, "column", round(value, 6) AS value FROM report"""
)
def profile_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.quality_report(_clean(spark, sf_dir)))


@query(
    f"""{WITH} {_each(TEXTS, '''SELECT '<c>' AS "column", mark, n FROM (
      SELECT 'N/A' AS mark, count(*) AS n FROM clean WHERE <c> = 'N/A'
      UNION ALL SELECT '', count(*) FROM clean WHERE <c> = '')''')}"""
)
def profile_text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.text_marks(_clean(spark, sf_dir), ["", "N/A"])


@query(
    "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1"
)
def profile_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_counts(table(spark, sf_dir, "documents"), "lang")


@query(
    f"""{WITH}, v AS ({_each(TEXTS, "SELECT '<c>' AS col, <c> AS value, count(*) AS n FROM clean WHERE <c> IS NOT NULL GROUP BY 2")})
    SELECT col AS "column", arg_min(value, (-n, value)) AS mode FROM v GROUP BY 1"""
)
def profile_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.modes(_clean(spark, sf_dir), TEXTS)


SCORES = f"""{duck('monthly')}, scores AS (SELECT * FROM ({" UNION ALL ".join(
    f"SELECT '{i}' AS indicator, {m} AS month, {i}_{m:02d}_score AS value FROM monthly"
    for i, months in (("bws", range(1, 13)), ("iav", (1, 2))) for m in months
)}) WHERE value BETWEEN 0 AND 5)"""


@query(
    f"{SCORES} SELECT indicator, month, round(avg(value), 6) AS mean_score FROM scores GROUP BY ALL"
)
def profile_monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.monthly_means(fixture(spark, sf_dir, "monthly")))


def _boxes(source: str, by: str) -> str:
    return f"""q AS (SELECT {by}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY ALL)
    SELECT {by}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      count(*) AS count, round(avg(value), 6) AS mean,
      round(min(CASE WHEN value BETWEEN q1 - (q3-q1)*1.5 AND q3 + (q3-q1)*1.5 THEN value END), 6) AS low_whisker,
      round(max(CASE WHEN value BETWEEN q1 - (q3-q1)*1.5 AND q3 + (q3-q1)*1.5 THEN value END), 6) AS high_whisker,
      count(CASE WHEN NOT value BETWEEN q1 - (q3-q1)*1.5 AND q3 + (q3-q1)*1.5 THEN 1 END) AS outliers
    FROM {source} JOIN q USING ({by}) GROUP BY ALL"""


@query(f"{SCORES}, {_boxes('scores', 'indicator, month')}")
def profile_monthly_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.monthly_distribution(fixture(spark, sf_dir, "monthly")))


@query(
    f"""{FIRES}, cells AS (
      SELECT 'brightness_temp_i4' AS "column", brightness_temp_i4 AS value FROM fires
      UNION ALL SELECT 'brightness_temp_i5', brightness_temp_i5 FROM fires
      UNION ALL SELECT 'log_frp', log10(greatest(frp_mw, 1)) FROM fires
      UNION ALL SELECT 'hours_old', hours_old FROM fires), {_boxes('cells', '"column"')}"""
)
def profile_fire_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = fixture(spark, sf_dir, "fires").withColumn("log_frp", log_power(F.col("frp_mw")))
    columns = ["brightness_temp_i4", "brightness_temp_i5", "log_frp", "hours_old"]
    cells = profiling.long_form(fires, columns, "double")
    return rounded(profiling.box_statistics(cells, ["column"]))


HISTOGRAM = """SELECT '<c>' AS "column", CAST(b.bin AS INT) AS bin, round(lo + (hi-lo)/30*b.bin, 6) AS low,
  round(lo + (hi-lo)/30*(b.bin+1), 6) AS high, count(v.bin) AS n
  FROM (SELECT min(<c>) AS lo, max(<c>) AS hi FROM clean) r
  CROSS JOIN (SELECT unnest(range(30)) AS bin) b
  LEFT JOIN (SELECT least(floor((<c> - lo) / ((hi-lo)/30)), 29) AS bin FROM clean,
    (SELECT min(<c>) AS lo, max(<c>) AS hi FROM clean) WHERE <c> IS NOT NULL) v ON v.bin = b.bin
  GROUP BY 1, 2, 3, 4"""


@query(f"{WITH} {_each(['bws_raw', 'gtd_raw'], HISTOGRAM)}")
def profile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = profiling.histograms(_clean(spark, sf_dir), ["bws_raw", "gtd_raw"])
    return rounded(binned, "low", "high")

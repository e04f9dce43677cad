"""File scans and sinks: CSV, landed feed pages, text documents, numbered exports."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.functions.columns import named, number, strip
from emberbasin.operators.countries import continents
from emberbasin.operators.text import LINE_BREAK
from emberbasin.schemas import FEED_PAGE

EXPORT_NAME = "VIIRS_Cleaned_Data"

# Texts that stand for a missing value when a raw CSV is read for cleaning.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema where there is one: inference reads the files twice."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV for cleaning: the usual missing-value texts are null, numbers are found despite them.

    Types come from one aggregation over all rows: a column is whole-number or
    double when every known text casts to it.
    """
    texts = spark.read.option("header", True).option("inferSchema", False).csv(path)
    known = {
        c: F.when(~strip(named(c)).isin(MISSING_TEXTS), named(c)) for c in texts.columns
    }
    masked = texts.withColumns(known)
    tests: list[Column] = []
    for i, c in enumerate(masked.columns):
        value = strip(named(c))
        bad = [value.isNotNull() & number(value, kind).isNull() for kind in ("bigint", "double")]
        tests += [F.count_if(bad[0]).alias(f"i{i}"), F.count_if(bad[1]).alias(f"d{i}")]
        tests.append(F.count(value).alias(f"n{i}"))
    found = masked.agg(*tests).first()
    typed = []
    for i, c in enumerate(masked.columns):
        value = named(c)
        if not found[f"n{i}"] or not found[f"d{i}"]:
            whole = found[f"n{i}"] and not found[f"i{i}"]
            value = number(strip(value), "bigint" if whole else "double")
        typed.append(value.alias(c))
    return masked.select(*typed)


def read_continents(spark: SparkSession, path: str) -> DataFrame:
    """``country, continent`` from CSV, trimmed."""
    return continents(read_csv(spark, path, "country string, continent string"))


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per ``features[].attributes``; the job fails on a page without ``features``."""
    kind = pages.schema["features"].dataType
    missing = F.raise_error("page has no 'features'").cast(kind)
    features = F.when(F.col("features").isNull(), missing).otherwise(F.col("features"))
    return pages.select(F.explode(features).alias("feature")).select("feature.attributes.*")


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Feed rows of landed JSON pages, one page per file."""
    return explode_pages(spark.read.schema(FEED_PAGE).option("multiLine", True).json(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: one row per file with its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, with its ``position`` from 0; a final line break opens no further line."""
    others = [c for c in docs.columns if c != text]
    closed = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return docs.where(F.col(text) != "").select(
        *others, F.posexplode(F.split(closed, LINE_BREAK)).alias("position", "line")
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A directory of CSV files with headers, one per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def next_export_path(
    spark: SparkSession, folder: str, base: str = EXPORT_NAME, day: date | None = None
) -> str:
    """``folder/base_YYYY-MM-DD_P<n>`` with n one above the highest there is, 1 when there is none."""
    stem = f"{folder.rstrip('/')}/{base}_{(day or date.today()).isoformat()}_P"
    try:
        files = spark.read.format("binaryFile").load(stem + "*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return stem + "1"
    number = F.regexp_extract("path", r"_P([0-9]+)(?:\.csv)?(?:/[^/]*)?$", 1)
    last = files.agg(F.max(number.try_cast("int")).alias("last")).first()["last"]
    return f"{stem}{(last or 0) + 1}"


def export_numbered(
    df: DataFrame, folder: str, base: str = EXPORT_NAME, day: date | None = None
) -> str:
    """Writes a dated, numbered CSV export and returns its path. Fails rather than overwrite one."""
    path = next_export_path(df.sparkSession, folder, base, day)
    write_csv(df, path, mode="errorifexists")
    return path

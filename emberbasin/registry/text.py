"""Documents and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberbasin import gazetteer
from emberbasin.fixtures import duck, fixture, table
from emberbasin.operators import places, text
from emberbasin.registry.base import query
from emberbasin.schemas import FIRE_WORDS, PLACE_PATTERN, WATER_WORDS

LINES = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
SPACE = r"'^\s+|\s+$', '', 'g'"
EXACT = ["The", "Le "]
ANY_CASE = ["license", "copyright"]


@query(
    """SELECT doc_id, length(text) AS char_count,
      CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000),
        chr(10), chr(10), '... (Text truncated. Total characters: ', length(text), ')') ELSE text END AS content,
      length(text) <= 2000 AS full_text_available,
      CASE WHEN length(text) = 0 THEN 'No extractable text found.' END AS warning
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""".replace(
        "length(text) AS char_count", "CAST(length(text) AS INT) AS char_count"
    )
)
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.snippets(table(spark, sf_dir, "documents").select("doc_id", "text"))


WANTED = " OR ".join(
    [f"starts_with(regexp_replace(x, {SPACE}), '#')"]
    + [f"contains(x, '{w}')" for w in EXACT]
    + [f"contains(lower(x), '{w}')" for w in ANY_CASE]
)


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(text, {LINES}), lambda x: {WANTED}) AS a
      FROM documents)
    SELECT doc_id, CAST(least(len(a), 20) AS INT) AS line_count,
      coalesce(array_to_string(list_transform(a[1:20], lambda x: regexp_replace(x, {SPACE})), chr(10)), '') AS outline
    FROM l"""
)
def text_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.outlines(docs, exact=EXACT, any_case=ANY_CASE)


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query(
    f"""{duck('questions')} SELECT conv_id, turn, ({_any(FIRE_WORDS)}) AS ask_fire,
      ({_any(WATER_WORDS)}) AS ask_water FROM questions"""
)
def text_route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.route_topics(fixture(spark, sf_dir, "questions")).drop("text")


@query(
    f"""{duck('questions')} SELECT conv_id, turn, false AS ask_fire, true AS ask_water
    FROM questions"""
)
def text_route_without_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.route_topics(
        fixture(spark, sf_dir, "questions"), enabled={"fire": False}, auto_detect=False
    ).drop("text")


MENTION = f"""nullif(regexp_replace(regexp_extract(text, '{PLACE_PATTERN}', 1), {SPACE}), '')"""


@query(f"{duck('questions')} SELECT conv_id, turn, {MENTION} AS place FROM questions")
def text_place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.place_mentions(fixture(spark, sf_dir, "questions")).drop("text")


@query(
    f"""{duck('questions')}, p(place, lat, lon) AS (SELECT * FROM (VALUES {', '.join(
        f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        for n, (a, b) in [*gazetteer.CITIES.items(), *gazetteer.COUNTRIES.items()]
    )}))
    SELECT conv_id, turn, m.place, lat, lon FROM (SELECT *, {MENTION} AS place FROM questions) m
    JOIN p ON lower(m.place) = lower(p.place)"""
)
def text_located_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text.place_mentions(fixture(spark, sf_dir, "questions")).drop("text")
    return places.locate(asked, gazetteer.places(spark))

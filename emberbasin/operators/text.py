"""Documents and questions as table columns: snippet, outline, topic routing, place mentions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.functions.columns import strip
from emberbasin.schemas import FIRE_WORDS, PLACE_PATTERN, WATER_WORDS

SNIPPET_CHARS = 2000
OUTLINE_LINES = 20
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TOPICS = {"fire": FIRE_WORDS, "water": WATER_WORDS}
EMPTY_WARNING = "No extractable text found."


def snippets(docs: DataFrame, text: str = "text", max_chars: int = SNIPPET_CHARS) -> DataFrame:
    """Length of the whole text, its beginning with a note when it was cut, and a warning when empty."""
    length = F.length(F.coalesce(text, F.lit("")))
    note = F.concat(
        F.lit("\n\n... (Text truncated. Total characters: "), length.cast("string"), F.lit(")")
    )
    content = F.when(
        length > max_chars, F.concat(F.substring(text, 1, max_chars), note)
    ).otherwise(F.coalesce(text, F.lit("")))
    others = [c for c in docs.columns if c != text]
    return docs.select(
        *others,
        length.alias("char_count"),
        content.alias("content"),
        (length <= max_chars).alias("full_text_available"),
        F.when(length == 0, EMPTY_WARNING).alias("warning"),
    )


def outlines(
    docs: DataFrame,
    text: str = "text",
    exact: Sequence[str] = ("VIIRS",),
    any_case: Sequence[str] = ("fire",),
    max_lines: int = OUTLINE_LINES,
) -> DataFrame:
    """Headings and lines with a keyword, trimmed, the first ``max_lines`` in order.

    Works on the line array of each text, so no row leaves its task.
    """

    def wanted(line: Column) -> Column:
        tests = [line.rlike(r"^\s*#")]
        tests += [line.contains(word) for word in exact]
        tests += [F.lower(line).contains(word.lower()) for word in any_case]
        return reduce(or_, tests)

    lines = F.filter(F.split(text, LINE_BREAK), wanted)
    outline = F.array_join(F.transform(F.slice(lines, 1, max_lines), strip), "\n")
    others = [c for c in docs.columns if c != text]
    return docs.select(
        *others,
        F.least(F.size(lines), F.lit(max_lines)).alias("line_count"),
        outline.alias("outline"),
    )


def needed_words(words: Sequence[str]) -> list[str]:
    """Words that contain no other word of the list: a text with "fires" always has "fire"."""
    lowered = list(dict.fromkeys(w.lower() for w in words))
    return [w for w in lowered if not any(o != w and o in w for o in lowered)]


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is a part of the text, in any case."""
    lowered = F.lower(text)
    return reduce(or_, [lowered.contains(w) for w in needed_words(words)], F.lit(False))


def route_topics(
    questions: DataFrame,
    text: str = "text",
    topics: Mapping[str, Sequence[str]] = TOPICS,
    enabled: Mapping[str, bool] | None = None,
    auto_detect: bool = True,
) -> DataFrame:
    """One boolean ``ask_<topic>`` per topic.

    With detection a topic is asked when its words occur and it is enabled;
    without it every enabled topic is asked.
    """
    on = {name: (enabled or {}).get(name, True) for name in topics}
    found = {
        f"ask_{name}": mentions(F.col(text), words) if auto_detect and on[name] else F.lit(on[name])
        for name, words in topics.items()
    }
    return questions.withColumns(found)


def place_mentions(
    questions: DataFrame, text: str = "text", pattern: str = PLACE_PATTERN
) -> DataFrame:
    """The first place named after "in", "around", "near" or "at" as ``place``; null when there is none."""
    found = strip(F.regexp_extract(text, pattern, 1))
    return questions.withColumn("place", F.when(found != "", found))

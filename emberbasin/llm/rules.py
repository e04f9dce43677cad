"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once a row; its outcome is one bit of ``failed`` and what it measured is
kept beside it. A policy is a named, versioned mask of rules: applying one, comparing two or asking what a rule
alone removes are bitwise operations on the ledger, without the texts. All of it is built-in functions.

Null and empty texts have no words: every count is 0, the base bits fail. Repeated rows are judged each.
Columns other than the text are passed through untouched unless they carry a name of the ledger; those are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import WHITE, fresh_names, own_columns, trimmed, word_array

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds."""

    name: str
    fails: str


#: The position of a rule is its bit, so rules are only ever added at the end.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("shouting", "2 * n_bangs > n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
BITS = {rule.name: bit for bit, rule in enumerate(RULES)}
BASE = ("too_few_words", "repeated_words")
#: Policies by name and version: the rules that count.
POLICIES = {
    ("base", 1): BASE,
    ("prose", 1): tuple(rule.name for rule in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_letters")


def without(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that the text has twice or more.

    Windows are sorted by (words, place); equal neighbours are repeats, and the places they cover are counted once.
    """
    last = F.size(words) - size
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), i.alias("i")),
    )
    ordered = F.sort_array(windows)

    def places(w: Column) -> Column:
        twice = F.filter(w, lambda x, j: (x["h"] == F.get(w, j - 1)["h"]) | (x["h"] == F.get(w, j + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # A place covers what the one before it doesn't.
        fresh = F.transform(
            p, lambda x, j: F.when(j == 0, F.lit(size)).otherwise(F.least(F.lit(size), x - F.get(p, j - 1)))
        )
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n)

    return F.when(F.size(words) > size, let(let(ordered, places), covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements, each a long, taken from the whole text; columns of docs that have their names, in any case, give way to them."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for n, c in zip(docs.columns, own_columns(docs)) if n.lower() not in {*MEASURES, "failed"}]
    (words, line) = fresh_names(docs, "_words", "_lines")
    lines = F.filter(F.split(body, F.lit("\n")), lambda line: trimmed(line) != "")
    staged = docs.select(*kept, word_array(F.col(text)).alias(words), lines.alias(line))
    return staged.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        (F.length(body) - without(body, WHITE)).cast("long").alias("word_chars"),
        without(body, SYMBOLS).alias("n_symbols"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col(words)).alias("n_repeat_words"),
        F.size(line).cast("long").alias("n_lines"),
        without(body, "!").alias("n_bangs"),
        F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measurements and ``failed``, a long whose bit b is set where rule b fails."""
    bits = None
    for bit, rule in enumerate(rules):
        one = F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    return measured(docs, text).withColumn("failed", bits)


def mask(policy: str, version: int) -> int:
    return sum(1 << BITS[name] for name in POLICIES[policy, version])


def passes(policy: str, version: int) -> Column:
    """True where no rule of the policy fails; over a ledger."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, version)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    One pass: ledger rows are counted by their failure bits, at most two to the power of the rules.
    """
    every = mask(policy, version)
    failed = F.col("failed").bitwiseAND(F.lit(every).cast("long"))
    counts = rows.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    summed = counts.agg(F.collect_list(F.struct("failed", "n")).alias("counts"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << BITS[n]).cast("long").alias("bit")) for n in POLICIES[policy, version]])
    paired = summed.select("counts", F.inline(rules))
    bit = F.col("bit")
    total = lambda keep: F.aggregate(
        F.filter("counts", keep), F.lit(0).cast("long"), lambda t, c: t + c["n"]
    )
    return paired.select(
        "rule",
        total(lambda c: c["failed"].bitwiseAND(bit) != 0).alias("fails"),
        total(lambda c: c["failed"] == bit).alias("fails_alone"),
        total(lambda c: c["failed"].bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
        total(lambda c: c["failed"] == 0).alias("kept"),
    )

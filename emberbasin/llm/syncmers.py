"""Fingerprints of documents from closed syncmers, by built-in functions only.

A text is cut into pieces of at most four characters that don't span white space, so that pieces fall in step again at each
word. A k-mer is ``k`` pieces in a row; it is kept where the smallest hash of its inner s-mers (``s`` pieces
in a row) is the first's or the last's. Whether it is kept depends on the k-mer alone, so equal passages keep equal anchors in any context, and
every window of ``2 * k`` pieces or so holds some.

A text of fewer pieces than ``k`` has its whole sequence of pieces as its one anchor. Null, empty and blank texts have none: they
are alike to each other and unlike any other text. Repeated anchors of a text count once in a likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.llm.common import fresh_names, own_columns

K = 12
S = 3
PIECE = r"\S{1,4}"
#: Ranges of ids; their first rows are broadcast, so this bounds the broadcast.
MOST_RANGES = 65_536
RANGE_ROWS = 256


def with_anchors(rows: DataFrame, text: str, out: str = "anchors", k: int = K, s: int = S, places: str | None = None) -> DataFrame:
    """Adds ``out``, the array of anchors in their order, and under the name ``places``, if given, the piece each starts at."""
    made = {x.lower() for x in (out, places) if x}
    names = [c for n, c in zip(rows.columns, own_columns(rows)) if n.lower() not in made]
    (p, n, h, at_) = fresh_names(rows, "_p", "_n", "_h", "_at")
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0))
    cut = rows.select(*names, pieces.alias(p))
    smers = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(p) - s, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(s)]),
    )
    hashed = cut.select(*names, F.size(p).alias(n), F.when(F.size(p) < k, F.array(F.xxhash64(p))).otherwise(smers).alias(h))
    last = k - s  # the place of a k-mer's last s-mer
    at = lambda i, j: F.get(h, i + j if j else i)

    def closed(i: Column) -> Column:
        first, end = F.lit(True), F.lit(True)
        for j in range(1, last + 1):
            first &= at(i, 0) <= at(i, j)
        for j in range(last - 1, -1, -1):
            end &= at(i, last) <= at(i, j)
        return first | end

    def anchor(i: Column) -> Column:
        steps = sorted({*range(0, last, s), last})  # s-mers that cover the k-mer
        return F.xxhash64(*[at(i, j) for j in steps])

    kept = F.filter(F.sequence(F.lit(0), F.col(n) - k), closed)
    none = F.array().cast("array<int>")
    starts = hashed.select(
        *names, n, h, F.when(F.col(n) == 0, none).when(F.col(n) < k, F.array(F.lit(0))).otherwise(kept).alias(at_)
    )
    value = F.when(F.col(n) < k, F.get(h, F.lit(0)))
    found = F.when(F.col(n) < k, F.transform(at_, lambda i: value)).otherwise(F.transform(at_, anchor))
    return starts.select(*names, found.alias(out), *([F.col(at_).alias(places)] if places else []))


def digest(anchors: Column) -> Column:
    """32 hexadecimal digits that stand for the values of the anchors in their order."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(anchors)), half(F.xxhash64(F.lit(1), anchors)))


def likeness(a: Column, b: Column) -> Column:
    """Shared values as a share of the mean number of values, 0 to 1; 1 where neither has any."""
    own, other = F.array_distinct(a), F.array_distinct(b)
    total = F.size(own) + F.size(other)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(own, other)) / total)


def in_id_ranges(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text, mark, _range and _guest: rows dealt by ranges of ids, and each range's first row also as the guest of the range before.

    The first range's guest goes to the last, so within a range a row's next is the next document, and the last one's
    the first. Texts are shuffled once. A null id sorts first; rows of one id sort by a hash of their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ends = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high, n = ends[0] or 0, ends[1] or 0, ends[2]
    width = max(1, -(-(high - low + 1) // min(MOST_RANGES, max(1, n // RANGE_ROWS))))
    key = F.greatest(F.floor((F.coalesce("doc_id", F.lit(low)) - low) / width), F.lit(0)).cast("long")
    rows = rows.select("*", F.xxhash64("text").alias("mark"), key.alias("_range"))
    firsts = rows.groupBy("_range").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    order = Window.orderBy("_range")
    last = F.max("_range").over(Window.partitionBy())
    firsts = firsts.select(
        F.coalesce(F.lag("_range").over(order), last).alias("_to"), F.col("_range"), F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")
    )  # at most MOST_RANGES rows
    guests = rows.alias("r").join(
        F.broadcast(firsts.alias("f")), F.expr("r._range = f._range AND r.doc_id <=> f._id AND r.mark = f._mark")
    )
    return rows.withColumn("_guest", F.lit(False)).unionByName(
        guests.select("r.doc_id", "r.text", "r.mark", F.col("f._to").alias("_range"), F.lit(True).alias("_guest"))
    )


def with_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, text, anchors, next_anchors, edited, edited_anchors of every row.

    ``edited`` is the text whose last quarter gave way to as much of the next document's beginning.
    """
    dealt = in_id_ranges(docs, id_col, text).repartition("_range")
    own = with_anchors(dealt, "text", "anchors", k, s)
    order = Window.partitionBy("_range").orderBy("_guest", "doc_id", "mark")
    paired = own.select(
        "*", F.lead("text").over(order).alias("_next"), F.lead("anchors").over(order).alias("next_anchors")
    ).filter("NOT _guest")
    tail = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - tail), F.substring("_next", F.lit(1), tail))
    return with_anchors(paired.select("doc_id", "text", "anchors", "next_anchors", edited.alias("edited")), "edited", "edited_anchors", k, s)

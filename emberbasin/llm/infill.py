"""Fill-in-middle: a text's lines are parted into prefix, middle and suffix, which are written out in another order.

Places where a cut may fall are kept as a compressed set of 32-bit numbers: the code points up to each line's end. The set has
a container for every 65,536 code points, an array of places, a bitmap, or runs, whichever is smallest, and running counts of places over the
containers. The place after k lines is found by a search in those counts, which names the container, and a select
inside it. Only the number of lines and the two cuts leave Python; texts are put together by built-ins.

Null and empty texts stay plain, and so do texts that hold one of the marks: their output is the text itself. Rows
without an id draw as the id '' would. Every row comes back once, repeated ones too, with the columns of ``docs`` as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import fresh_names, own_columns, string_bytes

SEED = 7
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text looked at together.
SLICE = 2_000_000
BITMAP_BYTES = 8192
KINDS = ("array", "bitmap", "runs")
CUTS = "n long, first long, second long"


class Array:
    """Places of one container as sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """Places of one container as 65,536 bits, with the count of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - int(self.before[word])])


class Runs:
    """Places of one container as starts of runs, with the count of places before each."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.starts, self.before = low[starts].astype(np.uint16), starts

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class Boundaries:
    """A set of places, given in rising order, that answers which is the k-th."""

    def __init__(self, places: np.ndarray):
        high = places >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[first]
        self.before = np.append(first, len(places))
        self.containers = [self.container(places[a:b] & 0xFFFF) for a, b in zip(self.before[:-1], self.before[1:])]

    @staticmethod
    def container(low: np.ndarray) -> Array | Bitmap | Runs:
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        sizes = (2 * len(low), BITMAP_BYTES, 4 * len(starts))
        kind = KINDS[int(np.argmin(sizes))]
        return Array(low) if kind == "array" else Bitmap(low) if kind == "bitmap" else Runs(low, starts)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def line_ends(texts: pa.Array) -> list[np.ndarray]:
    """For each text 0 and the code points up to the end of each of its lines; the last line may lack its line break."""
    data, starts = string_bytes(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    after = np.flatnonzero(data == 10) + 1
    first = np.searchsorted(after, starts, "right")  # a break that ends the text before isn't this text's
    out = []
    for a, b, i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        ends = after[i:j]
        open_end = [b] if b > a and (not len(ends) or ends[-1] != b) else []
        out.append(chars[np.concatenate([[a], ends, open_end]).astype(np.int64)] - chars[a])
    return out


def cuts(text: Column, one: Column, two: Column) -> Column:
    """A struct of n, the number of lines, and the code points before the middle and before the suffix, from two drawn numbers."""

    def found(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // SLICE
        draws = zip(ones.to_pylist(), twos.to_pylist())
        rows = []
        for start, end in zip(np.flatnonzero(np.diff(group, prepend=-1)), np.flatnonzero(np.diff(group, append=-1)) + 1):
            for places in line_ends(texts[start:end]):
                units = len(places)  # one more than lines
                a, b = sorted(x % units for x in next(draws))
                held = Boundaries(places)
                rows.append((units - 1, held.select(a), held.select(b)))
        columns = list(zip(*rows)) or [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])

    return F.arrow_udf(found, f"struct<{CUTS.replace(' ', ':').replace(',:', ',')}>")(text, one, two)


def draw(doc_id: Column, which: int, seed: int = SEED) -> Column:
    """The draw number ``which`` (0 to 3) of a document: 32 bits of a digest of seed and id, as a long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of those with the suffix first. Names that docs has
    already get underscores in front.
    """
    (n, form, prefix_chars, middle_chars, output, cut) = names = fresh_names(docs, "n", "form", "prefix_chars", "middle_chars", "output", "_cut")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(body, F.lit(mark))
    plain = (body == "") | marked | (F.pmod(draw(F.col(id_col), 2, seed), F.lit(100)) >= rate)
    kind = F.when(plain, "plain").when(F.pmod(draw(F.col(id_col), 3, seed), F.lit(100)) < spm, "spm").otherwise("psm")
    rows = docs.select(*own_columns(docs), cuts(body, draw(F.col(id_col), 0, seed), draw(F.col(id_col), 1, seed)).alias(cut), kind.alias(form))
    first, second = F.col(f"{cut}.first"), F.col(f"{cut}.second")
    prefix, middle = F.substring(body, F.lit(1), first.cast("int")), F.substring(body, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(body, (second + 1).cast("int"), F.length(body))
    p, s, m = map(F.lit, MARKS)
    out = F.when(F.col(form) == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col(form) == "spm", F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col(form) != "plain"
    return rows.select(
        *own_columns(docs),
        F.col(f"{cut}.n").alias(n),
        form,
        F.when(moved, first).alias(prefix_chars),
        F.when(moved, second - first).alias(middle_chars),
        out.otherwise(body).alias(output),
    ).select(*own_columns(docs), *names[:5])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transformed` was made from; marks stand in no transformed text, so they part it in four."""
    parts = F.split(output, "|".join(map(re.escape, MARKS)))
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )

"""Packing of documents into token sequences by exact complements.

The plan is made on the histogram of lengths, which has at most ``capacity`` entries
whatever the corpus holds. For each length, from the longest, the gap it leaves is looked up among single lengths,
sums of two and sums of three; a combination that fills the gap exactly is consumed as often as
the availability counts allow. What has no exact complement is packed best fit, longest first.
Each step of either part uses up a length, so the plan has at most two patterns a length.

Pieces are then dealt to the plan's slots: a piece gets its rank among the pieces of its
length (ranks within hashed buckets, plus the buckets before), and the rank names the slot.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberbasin.llm.common import fresh_names, own_columns, several, slices, stored, tidy

CAPACITY = 2048
#: Rows that share a length are ranked in buckets of about this many.
BUCKET_ROWS = 2_000
#: A worker that remembers more strings than this, some 60 MB, forgets those that the texts at hand don't have.
CACHE_WORDS = 300_000
#: Bytes of text encoded at a time.
SLICE = 4_000_000
END = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- tokens ------------------------------------------------------------------------------


#: Texts that the shortcut is for: ASCII, and Latin letters that have one lower case and take part in no composition.
PLAIN = re.compile("[\x00-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: What the pre-tokenizer parts such a text into, once it is in lower case.
PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\r\x0b\x0ca-z0-9\u00df-\u00f6\u00f8-\u017f]+")
# The normalizer and pre-tokenizer that the shortcut stands for.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """Ids of strings between white space, and of their parts, as little-endian bytes, each part encoded once while it is remembered.

    The vocabulary's pre-tokenizer drops white space and parts words, digits and signs, and no token spans two parts, so a text's ids are those of
    its parts end to end. New words are encoded together, with spaces between: each ends at the one token with the word-end mark.
    Texts with other characters than :data:`PLAIN` or with special strings, and all texts for any other kind of tokenizer file, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [x["type"] for x in steps] == NORMALIZERS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        known &= [x.get("type") for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": PATTERN} and before[0]["invert"]
        known &= spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and not before[-1].get("use_regex")
        self.known = bool(known and not spec["model"].get("ignore_merges"))
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # Words of letters in lower case come out of the normalizer as they went in, and white space is where they part.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.short_steps = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.ends = ends

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        words = list(filter(str.isalpha, parts))
        for part in parts.difference(words):
            self[part] = self.encoded(part)
        # Without offsets, which nobody asks for here.
        batches = [words[at : at + 2000] for at in range(0, len(words), 2000)]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.short_steps
        encoded = self.tokenizer.encode_batch_fast([" ".join(x) for x in batches], add_special_tokens=False)
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps
        for some, found in zip(batches, encoded):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            data = ids.tobytes()
            places = [0, *(4 * ends).tolist()]
            self.update(zip(some, map(data.__getitem__, map(slice, places, places[1:]))) if len(ends) == len(some) else ((w, self.encoded(w)) for w in some))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [self.known and PLAIN.fullmatch(t) is not None and not any(x in t for x in self.special) for t in texts]
        found = iter(self.of_plain([t.lower() for t, ok in zip(texts, plain) if ok]))
        return [next(found) if ok else self.encoded(t) for t, ok in zip(texts, plain)]

    def of_plain(self, texts: list[str]) -> Iterator[bytes]:
        """No part spans white space, so each distinct string between white space is looked up once, and the ids are gathered by number."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        strings = split.flatten().dictionary_encode()
        distinct = strings.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.get, distinct))
        unknown = [i for i, x in enumerate(ids) if x is None]
        if unknown:
            parts = [[x] if (x := distinct[i]).isalpha() else PART.findall(x) for i in unknown]
            wanted = set().union(*parts)
            found = {x: self[x] for x in wanted if x in self}
            if len(self) + 2 * len(unknown) > CACHE_WORDS:  # what these texts hold stays, so frequent words do
                kept = {x: y for x, y in zip(distinct, ids) if y is not None} | found
                self.clear()
                self.update(kept)
            self.learn(wanted.difference(found))
            for i, some in zip(unknown, parts):
                ids[i] = self[distinct[i]] = b"".join(map(self.__getitem__, some))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        number = strings.indices.to_numpy()
        counts = lengths[number]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")[several((np.cumsum(lengths) - lengths)[number], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[split.offsets.to_numpy()].tolist()
        return (flat[a:b].tobytes() for a, b in zip(ends, ends[1:]))


def word_ids(path: str) -> WordIds:
    """One per worker process, kept between its tasks."""
    held = sys.__dict__.setdefault("_emberbasin_word_ids", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: a document's ids and one end mark, cut only where longer.

    Null and empty texts give one piece of one id. Every row counts, also repeated ones and those without a doc_id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        end = np.array([END], dtype="<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in slices(batches, "text", SLICE):
            rows: list[tuple] = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, found in zip(batch.column(0).to_pylist(), ids.of(texts)):
                data = memoryview(found + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut), PIECES)


# -- the plan ----------------------------------------------------------------------------


class Exact:
    """Availability counts of lengths, and sums of pairs of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self.there = self.counts > 0
        size = len(counts)
        # How many pairs a <= b of available lengths have each sum below the capacity.
        self.pairs = np.zeros(size, dtype=np.int64)
        for a in np.flatnonzero(self.there):
            reach = self.there[: size - a] if a < size else self.there[:0]
            self.pairs[a:] += reach
        twice = 2 * np.flatnonzero(self.there)
        self.pairs[twice[twice < size]] += 1
        self.pairs //= 2
        two = 2 * np.flatnonzero(self.counts == 1)
        self.pairs[two[two < size]] -= 1

    def take(self, parts: list[int], times: int) -> None:
        for part in set(parts):
            before = self.counts[part]
            self.counts[part] = after = before - times * parts.count(part)
            if before > 1 >= after and 2 * part < len(self.pairs):
                self.pairs[2 * part] -= 1
            if before > 0 >= after:
                self.there[part] = False
                others = np.flatnonzero(self.there[: max(0, len(self.pairs) - part)])
                self.pairs[others + part] -= 1

    def pair(self, total: int, below: int) -> list[int] | None:
        """The pair with that sum and the longest first part, which isn't longer than ``below``."""
        if total < 2 or total >= len(self.pairs) or not self.pairs[total]:
            return None
        first = np.arange(min(total - 1, below), (total - 1) // 2, -1)
        found = first[self.there[first] & self.there[total - first] & ((2 * first != total) | (self.counts[first] > 1))]
        return [int(found[0]), int(total - found[0])] if len(found) else None

    def triple(self, total: int, below: int) -> list[int] | None:
        first = np.arange(min(total - 2, below), (total - 1) // 3, -1)
        first = first[self.there[first] & (self.pairs[total - first] > 0)] if len(first) else first
        for a in map(int, first):
            rest = self.pair(total - a, a)
            if rest and all(self.counts[x] >= [a, *rest].count(x) for x in (a, *rest)):
                return [a, *rest]
        return None

    def filling(self, gap: int, used: int) -> list[int] | None:
        """One, two or three lengths that fill the gap beside one piece of length ``used``."""
        if self.there[gap] and self.counts[gap] > (gap == used):
            return [gap]
        self.counts[used] -= 1  # its own piece isn't available
        alive = self.counts[used] > 0
        was = self.there[used]
        self.there[used] = alive
        try:
            return self.checked(self.pair(gap, gap)) or self.checked(self.triple(gap, gap))
        finally:
            self.counts[used] += 1
            self.there[used] = was

    def checked(self, parts: list[int] | None) -> list[int] | None:
        return parts if parts and all(self.counts[x] >= parts.count(x) for x in parts) else None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths that sum up to the capacity at most, and how often each is used."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int]] = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    exact = Exact(left)
    for length in range(capacity - 1, 0, -1):
        while exact.counts[length] > 0 and (parts := exact.filling(capacity - length, length)):
            pattern = [length, *parts]
            times = min(int(exact.counts[x]) // pattern.count(x) for x in set(pattern))
            exact.take(pattern, times)
            plan.append((pattern, times))
    left = exact.counts
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            pattern, gap, rest = [], capacity, left.copy()
            part = length
            while part:
                fit = min(gap // part, int(rest[part]))
                fit = fit if pattern else 1
                pattern += [part] * fit
                rest[part] -= fit
                gap -= part * fit
                fits = np.flatnonzero(rest[1 : gap + 1] > 0)
                part = int(fits[-1]) + 1 if len(fits) else 0
            used = np.bincount(pattern, minlength=capacity + 1)
            times = int((left[used > 0] // used[used > 0]).min())
            left -= used * times
            plan.append((pattern, times))
    return plan


def slot_table(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset), in the order of ranks; a run's ranks go up with its sequences."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = dict.fromkeys(range(capacity + 1), 0)
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for part in pattern:
            slots.setdefault(part, []).append((used[part], sequence, offset))
            used[part] += times
            offset += part
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``; other columns come back as they are, and
    where one has such a name the new one has underscores in front.

    Empty input gives no rows. Equal rows each get a place of their own. ``pieces`` has to be
    repeatable (a written table), as it is read once for the histogram and once for the ranks.
    """
    spark = pieces.sparkSession
    lengths = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    if bad := [r["length"] for r in lengths if r["length"] is None or not 1 <= r["length"] <= capacity]:
        raise ValueError(f"lengths out of 1 to {capacity}: {bad[:5]}")
    plan = plan_sequences({r["length"]: r["count"] for r in lengths}, capacity)
    slots = slot_table(plan, capacity)
    names = pieces.columns
    (sequence_id, offset_, n, bucket, row, first, rank_) = fresh_names(pieces, "sequence_id", "offset", "_buckets", "_bucket", "_row", "_before", "_rank")
    # A length has buckets as its rows need them; a row a length, so at most ``capacity`` rows are broadcast.
    buckets = spark.createDataFrame([(r["length"], -(-r["count"] // BUCKET_ROWS)) for r in lengths], f"length long, `{n}` long")
    own = own_columns(pieces)
    dealt = pieces.join(F.broadcast(buckets), "length").select(*own, F.pmod(F.xxhash64(*own), F.col(n)).alias(bucket))
    # The rows before a bucket among those of its length, by two narrow sums.
    sums = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(row))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", bucket, F.coalesce(F.sum(row).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("length", bucket).orderBy(*own)
    ranked = (
        dealt.withColumn(row, F.row_number().over(within))
        .join(sums, ["length", bucket])
        .select(*own, (F.col(first) + F.col(row) - 1).alias(rank_))
    )
    table = spark.sparkContext.broadcast(slots)  # its size follows the capacity, not the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index(rank_)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                runs = at[int(value)]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
                sequence[rows] = run[:, 1] + rank[rows] - run[:, 0]
                offset[rows] = run[:, 2]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != rank_]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, sequence_id, offset_])

    tick = "`"
    schema = ", ".join(f"`{f.name.replace(tick, 2 * tick)}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, `{sequence_id}` long, `{offset_}` long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written once to the shared folder."""
    return pack(stored(cut_pieces(docs, tokenizer, capacity)), capacity)

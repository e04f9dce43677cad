"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another text or in the same.

1. Equal texts become one class; what has the length and a second copy goes as a whole.
2. Shards by content: every window of ``length`` bytes is named by its smallest k-mer (by a hash of its bytes), so equal windows have
   equal names. Neighbouring windows of one name are a run, and a run's bytes are its segment. Names are counted before the shuffle, and
   those of a single run end there; equal segments of one name are counted and become one.
3. Each shard takes whole names. Its segments stand end to end, and Larsson-Sadakane refinement sorts their suffixes:
   first by seven bytes, then, within groups that are still equal, by the rank of the suffix as far ahead as is
   already sorted, doubling that. Kasai's pass carries the common prefix from each suffix to the next, over all segments at
   once; neighbours in the suffix array with a common prefix of ``length`` are repeats.
4. A name with many different segments is dealt to several shards. Each passes on one window for each group of equal ones, and
   these are merged across shards by binary search.
5. The repeated runs of each text are united and cut out.

Null, empty and shorter texts keep all bytes. Repeated rows are copies. No list of segments, runs or windows is cut; texts of any length are taken whole,
in blocks that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import discard, fresh_names, mixed64, own_columns, several, slices, stored, string_bytes, text_key, tidy, written
from emberbasin.llm.shingles import BASES, STEP, powers
from emberbasin.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS

LENGTH = 200
#: Bytes of the k-mers that name windows.
SEED = 64
SLICE = 1_500_000
#: A longer text is taken in blocks; low bits of a key tell the places of a block apart.
BLOCK = 8_000_000
PLACE = np.uint64((1 << 24) - 1)
#: Windows of a run.
MOST = 1024
#: Bytes of a shard's suffix array, and as many different segments of a name as usually make that up.
SHARD = 1_200_000
SEGMENTS = SHARD // 300


class Bytes:
    """Hashes of ranges of bytes, from sums of powers; tables are kept between batches."""

    def __init__(self) -> None:
        self.values = [mixed64(np.arange(a, a + 256, dtype=np.uint64)) for a in (1000, 5000)]
        self.up, self.down = powers(1 << 12)

    def grow(self, n: int) -> None:
        if n + 1 > len(self.up):
            self.up, self.down = powers(max(n + 1, 2 * len(self.up)))

    def ranges(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[which][data] * self.up[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[begins]) * self.down[begins]
        return mixed64(found + (ends - begins).astype(np.uint64) * BASES[which])

    def kmers(self, data: np.ndarray, k: int) -> np.ndarray:
        """The hash of the k bytes from each place on."""
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[0][data] * self.up[: len(data)], out=sums[1:])
        return mixed64((sums[k:] - sums[:-k]) * self.down[: len(data) - k + 1])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours: running minima of blocks, from the left and from the right."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, ~np.uint64(0), np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, hashes: Bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """name, digest, first window, windows and whether the name stands twice in the run, of all runs of texts that lie end to end."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    names = hashes.kmers(data, seed)
    keys = (names & ~PLACE) | np.arange(len(names), dtype=np.uint64)
    smallest = least(keys, length - seed + 1)
    # Windows that lie within one text.
    valid = np.ones(len(smallest), bool)
    inner = starts[1:-1]
    for back in (several(inner - length + 1, np.full(len(inner), length - 1)),):
        valid[back[(back >= 0) & (back < len(valid))]] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    place = (smallest[at] & PLACE).astype(np.int64)
    apart = np.concatenate([[True], at[1:] != at[:-1] + 1])
    text = np.searchsorted(starts, at, "right")
    apart[1:] |= text[1:] != text[:-1]
    moved = np.concatenate([[False], place[1:] != place[:-1]])
    name = names[place]
    new = apart | np.concatenate([[True], name[1:] != name[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    tied = np.add.reduceat((moved & ~new).astype(np.int64), first) > 0
    if count.max() > MOST:  # long runs of one name, as in a text of one letter, become several
        parts = -(-count // MOST)
        first, tied = np.repeat(first, parts) + several(np.zeros(len(parts)), parts) * MOST, np.repeat(tied, parts)
        count = np.diff(np.append(first, len(at)))
    begin = at[first]
    digest = hashes.ranges(data, begin, begin + count + length - 1, 1)
    return name[first], digest, begin, count, tied


def blocks_of(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts, rows and offsets of the batch's texts; a long text comes alone, in blocks."""
    data, starts = string_bytes(batch.column(column))
    if len(data) <= BLOCK:
        yield data, starts, np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        return
    for row in range(batch.num_rows):
        one = data[starts[row] : starts[row + 1]]
        for at in range(0, max(1, len(one) - length + 1), BLOCK - length + 1):
            part = one[at : at + BLOCK]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def runs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """h, d, k1, k2, at, n and tied of each run; ``texts`` has k1, k2 and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Bytes()
        for batch in slices(batches, "text", SLICE):
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for data, starts, rows, offsets in blocks_of(batch, 2, length):
                name, digest, begin, count, tied = runs_of(data, starts, hashes, length, seed)
                if not len(name):
                    continue
                # A text's start may be shared by empty ones before it: the last of them.
                text = np.searchsorted(starts, begin, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(keys[0][rows[text]]), pa.array(keys[1][rows[text]]),
                        pa.array(begin - starts[text] + offsets[text]), pa.array(count.astype(np.int32)), pa.array(tied),
                    ],
                    ["h", "d", "k1", "k2", "at", "n", "tied"],
                )

    return texts.select("k1", "k2", "text").mapInArrow(tidy(work), "h long, d long, k1 long, k2 long, at long, n int, tied boolean")


SEGMENT = "h long, part int, parts int, k1 long, k2 long, at long, n int, alone boolean, bytes binary"


def segments(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs; ``texts`` has text and wanted, an array of (h, part, parts, k1, k2, at, n, alone)."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows, held = [], 0
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(text.as_buffer())
                for w in wanted:
                    part = bytes(data[w["at"] : w["at"] + w["n"] + length - 1])
                    rows.append((*(w[n] for n in names[:-1]), part))
                    held += len(part)
                if held > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.select("text", "wanted").mapInArrow(tidy(work), SEGMENT)


# -- suffix arrays -----------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in their order, and the rank of each place; ``symbols`` are 0 to 256."""
    n = len(symbols)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = symbols
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    ahead = 7
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_):
        place = order[open_]
        # The rank of the suffix ahead sorts what is equal so far; beyond the end comes first.
        key = (rank[place] << 32) | (rank[np.minimum(place + ahead, n)] + 1)
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[open_] = place
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[place] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        alone = first & np.append(first[1:], True)
        open_ = open_[~alone]
        ahead *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, left: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For the first ``counts`` places of each segment: the bytes in common with the suffix before in order, up to ``most``.

    ``left`` is how far a place's segment goes on. Kasai's pass, over all segments side by side: the next place has at most one less.
    """
    n = len(data)
    words = np.zeros(n + 16, np.uint64)
    padded = np.zeros(n + 24, np.uint8)
    padded[:n] = data
    for i in range(8):
        words |= padded[i : i + n + 16].astype(np.uint64) << np.uint64(8 * i)
    prefix = np.zeros(n, np.int64)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, "left"))
        place = starts[:live] + step
        above = rank[place] - 1
        other = order[np.maximum(above, 0)]
        limit = np.where(above < 0, 0, np.minimum(np.minimum(left[place], left[other]), most))
        reach = np.minimum(np.maximum(held[:live] - 1, 0), limit)
        going = np.flatnonzero(reach < limit)
        while len(going):
            differ = words[place[going] + reach[going]] ^ words[other[going] + reach[going]]
            lowest = differ & (~differ + np.uint64(1))
            step_by = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
            reach[going] = np.minimum(reach[going] + step_by, limit[going])
            going = going[(differ == 0) & (reach[going] < limit[going])]
        held[:live] = reach
        prefix[place] = reach
    return prefix


def repeated(parts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments: their bytes end to end (each with a gap after it), starts, which places start a repeat,
    which are the first of their group, and how many windows each has."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = data.astype(np.int64) + 1
    gaps = starts + sizes
    symbols[gaps] = 0
    left = np.repeat(gaps, sizes + 1) - np.arange(len(data))
    order, rank = suffix_array(symbols)
    prefix = common_prefixes(data, order, rank, left, starts, counts, length)
    windows = several(starts, counts)
    again = windows[prefix[windows] >= length]
    hit = np.zeros(len(data), bool)
    hit[again] = True
    hit[order[rank[again] - 1]] = True
    lead = np.zeros(len(data), bool)
    lead[windows] = prefix[windows] < length
    return data, starts, hit, lead, windows


FOUND = "k1 long, k2 long, low long, high long, w1 long, w2 long"


def shard_repeats(rows: DataFrame, length: int) -> DataFrame:
    """Repeated runs (k1, k2, low, high) in bytes, and, of names dealt to several shards, one window of each group (w1, w2 not null)."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = Bytes()
        counts = np.array([r[6] for r in held], np.int64)
        data, starts, hit, lead, windows = repeated([r[8] for r in held], counts, length)
        owner = np.repeat(np.arange(len(held)), counts)
        keys = np.array([(r[3], r[4]) for r in held], np.int64)
        offset = np.array([r[5] for r in held], np.int64) - starts
        alone = np.array([r[7] for r in held])
        # Runs of repeats of segments that aren't known as repeats already.
        wanted = hit[windows] & alone[owner]
        place, own = windows[wanted], owner[wanted]
        if len(place):
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (own[1:] != own[:-1])]))
            last = np.append(first[1:], len(place)) - 1
            o = own[first]
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[o, 0]), pa.array(keys[o, 1]), pa.array(place[first] + offset[o]), pa.array(place[last] + offset[o] + length), none, none], names
            )
        spread = np.array([r[2] > 1 for r in held])
        if spread.any():
            export = lead[windows] & spread[owner]
            place, own = windows[export], owner[export]
            w = [hashes.ranges(data, place, place + length, i).view(np.int64) for i in (0, 1)]
            low = place + offset[own]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own, 0]), pa.array(keys[own, 1]), pa.array(low), pa.array(low + length), pa.array(w[0]), pa.array(w[1])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, here = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for row in zip(*columns):
                if row[:2] != here:
                    here = row[:2]
                    if size > SHARD:
                        yield from solve(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[8])
        if held:
            yield from solve(held)

    dealt = rows.repartition("h", "part").sortWithinPartitions("h", "part", "k1", "k2", "at")
    return dealt.mapInArrow(tidy(work), FOUND)


def merged(windows: DataFrame) -> DataFrame:
    """Of one window for each shard and group: those that another shard has too, found by binary search."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        first, second = (every.column(n).to_numpy() for n in ("w1", "w2"))
        order = np.lexsort((second, first))
        ordered = first[order]
        low, high = np.searchsorted(ordered, first, "left"), np.searchsorted(ordered, first, "right")
        twice = high - low > 1
        # Equal first halves: the second decides, which sorted the run too.
        rows = np.flatnonzero(twice)
        keep = [i for i in rows.tolist() if (lambda s: np.searchsorted(s, second[i], "right") - np.searchsorted(s, second[i], "left") > 1)(second[order[low[i] : high[i]]])]
        out = every.take(pa.array(keep, pa.int64())).select(["k1", "k2", "low", "high"]).combine_chunks()
        yield from out.to_batches()

    return windows.repartition("w1").select("k1", "k2", "low", "high", "w1", "w2").mapInArrow(tidy(work), "k1 long, k2 long, low long, high long")


# -- whole tables ------------------------------------------------------------------------


CUT = "struct<n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>"


def cut_out(text: Column, whole: Column, spans: Column, keep_text: bool = False) -> Column:
    """A struct of n_removed, n_spans, kept_sha256 and (if wanted) kept, the bytes left, of a text that loses ``spans``, or all if ``whole``.

    Null where ``whole`` is."""

    def work(texts: pa.Array, wholes: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for text, whole, spans in zip(texts, wholes.to_pylist(), lists.to_pylist()):
            if whole is None:
                rows.append((None, None, None, None))
                continue
            data = memoryview(text.as_buffer())
            found, end, parts, removed, count = [(0, len(data))] if whole else sorted((s["low"], s["high"]) for s in spans or []), 0, [], 0, 0
            for low, high in found:
                if low > end or not count:
                    parts.append(data[end:low])
                    count += 1
                    removed += high - low
                    end = high
                elif high > end:
                    removed += high - end
                    end = high
            parts.append(data[end:])
            kept = b"".join(parts)
            rows.append((removed, count, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        columns, kinds = list(zip(*rows)) or [[]] * 4, [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        none = pa.array([r[0] is None for r in rows], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_removed", "n_spans", "kept_sha256", "kept"], mask=none)

    return F.arrow_udf(work, CUT)(text, whole, spans)


def repeat_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text") -> DataFrame:
    """k1, k2, whole and spans (an array of low, high) of each different text that loses bytes; narrow, and stored.

    ``whole``: the text has copies, so all of it goes; it has at least ``length`` bytes."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long_ones = docs.select(body.alias("text")).filter(F.octet_length("text") >= length).select(*text_key(F.col("text")), "text")
    every = runs(long_ones, length, seed).withColumn("_place", F.xxhash64("k1", "k2", "at"))
    # A name of two places or more, copies of a text aside; counted before the shuffle.
    again = every.groupBy("h").agg(
        F.min("_place").alias("_from"), F.max("_place").alias("_to"), F.min("d").alias("_low"), F.max("d").alias("_high"), F.max("tied").alias("_tied")
    ).filter("_from <> _to OR _tied").select("h", "_low", "_high", (F.col("_from") != F.col("_to")).alias("_several"))
    # Read three times below, so it is written once.
    table = written(every.drop("_place", "tied").join(again, "h"), "runs")
    found = table.dropDuplicates(["h", "k1", "k2", "at"])
    span = ["k1", "k2", F.col("at").alias("low"), (F.col("at") + F.col("n") + (length - 1)).alias("high")]
    # One segment, on several places: all of its windows are repeats.
    solid = found.filter("_several AND _low = _high").select(*span)
    mixed = found.filter("NOT (_several AND _low = _high)").select("h", "d", "k1", "k2", "at", "n")
    kinds = mixed.groupBy("h", "d").agg(F.count(F.lit(1)).alias("_times"), F.min(F.struct("k1", "k2", "at", "n")).alias("one"))
    copied = mixed.join(kinds.filter("_times > 1").select("h", "d"), ["h", "d"]).select(*span)
    parts = kinds.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SEGMENTS).cast("int").alias("parts")).filter("parts > 1")
    wanted = stored(
        kinds.join(parts, "h", "left")
        .select(
            "h", F.coalesce(F.pmod("d", F.col("parts")), F.lit(0)).cast("int").alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"),
            "one.k1", "one.k2", "one.at", "one.n", (F.col("_times") == 1).alias("alone"),
        )
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "part", "parts", "k1", "k2", "at", "n", "alone")).alias("wanted"))
    )
    # Of copies of a text one is cut into segments; where few texts are wanted, only those are shuffled.
    texts, keys = long_ones, wanted.select("k1", "k2")
    if keys.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    cut = segments(texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"]), length)
    solved = shard_repeats(cut, length)
    solved = written(solved, "solved")
    within = solved.filter("w1 IS NULL").select("k1", "k2", "low", "high")
    across = merged(solved.filter("w1 IS NOT NULL"))
    spans = (
        solid.unionByName(copied).unionByName(within).unionByName(across)
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    )
    copies = long_ones.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    whole = F.col("copies").isNotNull()
    losing = stored(
        spans.join(copies, ["k1", "k2"], "full").select("k1", "k2", whole.alias("whole"), F.when(whole, none).otherwise(F.col("spans")).alias("spans"))
    )
    discard(table)
    discard(solved)
    return losing


def without_repeated(docs: DataFrame, keep_text: bool = False, length: int = LENGTH, seed: int = SEED, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the struct ``cut`` (:func:`cut_out`), null where the text loses nothing; under another name where docs has that one.

    Spans go to the texts, not the other way round: where they are measured to be small they are broadcast and no text is shuffled."""
    (k1, k2, whole, spans, cut) = fresh_names(docs, "_k1", "_k2", "_whole", "_spans", "cut")
    losing = repeat_spans(docs, length, seed, text).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("whole").alias(whole), F.col("spans").alias(spans))
    rows, places = losing.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and 48 * rows + 16 * places <= BROADCAST_BYTES:
        losing = F.broadcast(losing)
    marked = docs.select(*own_columns(docs), *[k.alias(n) for k, n in zip(text_key(F.col(text)), (k1, k2))])
    joined = marked.join(losing, [k1, k2], "left")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    loses = F.col(whole).isNotNull()  # other texts don't go to Python
    return joined.select(*own_columns(docs), cut_out(F.when(loses, body), F.col(whole), F.col(spans), keep_text).alias(cut))

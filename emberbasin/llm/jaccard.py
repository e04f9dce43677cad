"""Self-join of documents by the Jaccard similarity of their word shingles, by T-occurrence search.

1. One pass over all texts gives each its class (texts with the same words, case of A-Z aside) and counts shingles that
   recur within a task. Classes stand for their copies from here on.
2. Shingles are put in one order for all: recurring ones last, by their count, others by their hash. A class lists its first
   ``n - ceil(t * n) + 1`` shingles: two sets that reach t share one of these. Only the listed shingles are
   shuffled, and those that a single class lists end there. Recurring ones are counted before the shuffle.
3. A class lives at that of its listed shingles which most classes list (its home), so that a group lives at one place, and visits
   every other home that has a class with which it shares a listed shingle, unless sizes and places rule a link out.
   Any two classes that may link meet at the home of one of them.
4. A home of very many shingles is split into parts. Its classes first meet a few leaders there, one row each; those that fall into one
   component needn't meet again. Only classes outside a home's largest component visit its other parts, so a group of near copies isn't
   squared, whatever its size.
5. At each home an inverted index over its classes is searched with DivideSkip: the T-occurrence bound is
   the least overlap that t allows, the longest lists are set aside, the short ones are merged into counts,
   and what reaches the rest of the bound is looked up in the long ones by binary search. The exact overlap then decides.
   Classes that a search has found don't search themselves, unless they stay outside the largest component of the place.
   A home returns a forest that connects what is linked, never pairs.
6. Components of the forests.

No list of partners or candidates is cut. The order in step 2 bears on cost alone, so the table of recurring shingles may be bounded.
With ``links`` every class searches wherever it may link, so links can be counted: work that grows with their number, a square of a group.

Null and blank texts have no shingles and link with nothing. Rows without an id get the component of equal texts that have one, else null.
Rows of one id with different texts count as one document that has both. Repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import discard, mixed64, several, slices, stored, tidy, written
from emberbasin.llm.graph import components
from emberbasin.llm.shingles import WORDS, Hasher, sequence_hashes, shingle_sets
from emberbasin.plans.joins import BROADCAST_ROWS

#: Similarity in hundredths.
PERCENT = 75
#: Text bytes hashed at a time (a worker holds some 100 bytes for each of them), and shingles counted at a time.
SLICE = 500_000
COUNTED = 3_000_000
#: A shingle counts as recurring from so often (two at least) within what a task counts at a time; so many are kept, the most frequent.
OFTEN = 2
RECURRING = 200_000
#: Copies that a task remembers before it forgets them all.
SEEN = 300_000
#: Shingles of a home's classes that one index takes.
INDEX = 400_000
#: Classes of a split home that all others of it meet first.
LEADERS = 8
#: DivideSkip's weight of a probe against a merge.
MU = 0.4


def listed_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def listed_sql(n: str, percent: int) -> str:
    return f"({n} - ceil({percent} * {n} / 100) + 1)"


def scanned(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Rows (doc_id, mark, c1, c2, n) of texts, and rows (c1, often) of shingles that recur, told apart by ``often``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = Hasher(), [], 0
        names = ["doc_id", "mark", "c1", "c2", "n", "often"]

        def often() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            same = np.concatenate([[False], every[1:] == every[:-1], [False]])  # as the one before; only runs of two or more get numbers
            first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
            times = last - first + 1
            keep = times >= OFTEN
            shingle, times = every[first[keep]].view(np.int64), times[keep]
            none = pa.nulls(len(times), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(shingle), none, none, pa.array(times.astype(np.int64))], names)

        for batch in slices(batches, "text", SLICE):
            words, at = hasher.words(batch.column(2))
            sets = shingle_sets(words, at, size)
            c1, c2 = sequence_hashes(words, at)
            n = np.array([len(s) for s in sets], np.int64)
            # Texts of one shingle, which may repeat it, are a class by that.
            for i in np.flatnonzero(n == 1).tolist():
                c1[i], c2[i] = sets[i][0], mixed64(~sets[i])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.int64())], names
            )
            held += sets
            count += int(n.sum())
            if count > COUNTED:
                yield often()
                held, count = [], 0
        if count:
            yield often()

    rows = docs.select("doc_id", "mark", "text")
    return rows.mapInArrow(tidy(scan), "doc_id long, mark long, c1 long, c2 long, n long, often long")


def listed(rows: DataFrame, order, percent: int, size: int) -> DataFrame:
    """c1, n, the listed shingles ``s`` in order, and how many of them aren't known to recur (``cold``, which come first), of each text.

    Copies that a task has seen already are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, rank), seen = Hasher(), order.value, set()
        for batch in slices(batches, "text", SLICE):
            words, at = hasher.words(batch.column(0))
            c1, c2 = sequence_hashes(words, at)
            names, counts, lists, colds = [], [], [], []
            for a, b, one in zip(c1.tolist(), c2.tolist(), shingle_sets(words, at, size)):
                if len(one) < 2 or (a, b) in seen:  # sets of one shingle link with equal ones only
                    continue
                seen.add((a, b))
                cold = len(one)
                if len(known):
                    place = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    level = np.where(known[place] == one, rank[place], 0)
                    cold -= int(np.count_nonzero(level))
                    one = one[np.argsort(level, kind="stable")] if level.any() else one
                colds.append(cold)
                names.append(a)
                counts.append(len(one))
                lists.append(one[: listed_length(len(one), percent)])
            if len(seen) > SEEN:
                seen.clear()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(counts, pa.int32()), pa.array(colds, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["c1", "n", "cold", "s"],
            )

    return rows.select("text").mapInArrow(tidy(work), "c1 long, n int, cold int, s array<long>")


def sent(base: DataFrame, size: int) -> DataFrame:
    """A row for each class and home (and part of a home) it visits: its whole sorted set, whether it lives there, its copies.

    ``base`` has rep, text, copies and visits, an array of (home, parts, own, round): a class that lives at a home
    goes to the other parts of it only if it makes the round; a visitor goes to all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["home", "part", "own", "rep", "copies", "s"]
        for batch in slices(batches, "text", SLICE):
            words, at = hasher.words(batch.column(1))
            rows, held = [], 0
            sets = shingle_sets(words, at, size)
            for rep, copies, visits, one in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets):
                data = one.tobytes()
                for visit in visits:
                    for part in range(visit["parts"]):
                        lives = visit["own"] and part == rep % visit["parts"]
                        if visit["own"] and not lives and not visit["round"]:
                            continue
                        rows.append((visit["home"], part, bool(lives), rep, copies, data))
                        held += len(data)
                if held > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), SENT_KINDS)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), SENT_KINDS)], names)

    return base.select("rep", "text", "copies", "visits").mapInArrow(tidy(work), "home long, part int, own boolean, rep long, copies long, s binary")


SENT_KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]


class Index:
    """Inverted lists over the sets of a home's classes."""

    def __init__(self, reps: list[int], copies: list[int], sets: list[np.ndarray]):
        self.reps, self.copies = np.array(reps, np.int64), np.array(copies, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.lists = flat[order], member[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])
        self.known = flat[first]
        self.starts = np.append(np.flatnonzero(first), len(flat))
        self.keys = (np.cumsum(first) - 1) * len(sets) + self.lists  # (list, member) as one sorted number
        self.up = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def search(self, one: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that reach the least overlap with the set, and their overlaps: DivideSkip."""
        none = np.zeros(0, np.int64)
        least = -(-percent * len(one) // 100)  # no partner of any size allows less
        place = np.minimum(np.searchsorted(self.known, one), len(self.known) - 1)
        place = place[self.known[place] == one]
        if len(place) < least:
            return none, none
        lengths = self.starts[place + 1] - self.starts[place]
        by_length = np.argsort(lengths, kind="stable")
        longest = int(lengths[by_length[-1]])
        aside = min(least - 1, int(least / (MU * np.log2(longest + 1) + 1)))
        short, long = place[by_length[: len(place) - aside]], place[by_length[len(place) - aside :]]
        # Merge: how many short lists each member is on.
        merged = self.lists[several(self.starts[short], self.starts[short + 1] - self.starts[short])]
        counts = np.bincount(merged, minlength=len(self.reps))
        found = np.flatnonzero(counts >= max(1, least - aside))
        overlap = counts[found]
        # Skip: the long lists are only probed for what is left.
        if aside and len(found):
            probes = (long[:, None] * len(self.reps) + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            overlap = overlap + (self.keys[at] == probes).reshape(len(long), len(found)).sum(axis=0)
        keep = overlap >= least
        return found[keep], overlap[keep]

    def links(self, rep: int, one: np.ndarray, percent: int) -> np.ndarray:
        found, overlap = self.search(one, percent)
        union = len(one) + self.sizes[found] - overlap
        return found[(100 * overlap >= percent * union) & (self.reps[found] != rep)]

    def unite(self, hit: np.ndarray) -> None:
        first = self.root(int(hit[0]))
        for i in hit[1:].tolist():
            self.up[self.root(i)] = first

    def unite_members(self, sets: list[np.ndarray], percent: int) -> None:
        """Connects members that are linked, directly or by others here, without a search for each.

        Members that no earlier one has found search first. Then all outside the largest component search: of two linked members at
        least one has searched, or both are in that component already."""
        asked, found = np.zeros(len(sets), bool), np.zeros(len(sets), bool)

        def ask(i: int) -> None:
            asked[i] = True
            hit = self.links(int(self.reps[i]), sets[i], percent)
            found[hit] = True
            if len(hit):
                self.unite(np.append(hit, i))

        for i in range(len(sets)):
            if not found[i]:
                ask(i)
        roots = [self.root(i) for i in range(len(sets))]
        main = max(set(roots), key=roots.count) if len(sets) < 50 else int(np.bincount(roots).argmax())
        for i in np.flatnonzero(~asked).tolist():
            if self.root(i) != self.root(main):
                ask(i)

    def forest(self) -> list[tuple[int, int, int]]:
        """(node, links, peer) that tie each member to the root of its tree."""
        reps = self.reps
        return [(int(reps[i]), 0, int(reps[r])) for i in range(len(reps)) if (r := self.root(i)) != i]


def searched(rows: DataFrame, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """node, links, peer: edges of the forests, and with ``links`` the links of each class; ``rows`` as :func:`sent` makes them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, members, index, out = None, ([], [], []), None, []

        def ask(rep: int, one: np.ndarray) -> None:
            hit = index.links(rep, one, percent)
            if len(hit):
                index.unite(hit)
                out.append((rep, int(index.copies[hit].sum()), int(index.reps[hit[0]])))

        def opened() -> Index | None:
            made = Index(*members) if members[0] else None
            return made

        def ask_members() -> None:
            if not links:
                return index.unite_members(members[2], percent)
            for rep, one in zip(members[0], members[2]):
                ask(rep, one)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["node", "links", "peer"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for home, part, own, rep, copies, data in zip(*columns, batch.column(5)):
                if (home, part) != here:
                    if here is not None:
                        if index is None and members[0]:
                            index = opened()
                            ask_members()
                        if index is not None:
                            out += index.forest()
                    here, members, index = (home, part), ([], [], []), None
                one = np.frombuffer(data.as_py(), np.uint64)
                if own:
                    for held, x in zip(members, (rep, copies, one)):
                        held.append(x)
                    continue
                if index is None and members[0]:
                    index = opened()
                    ask_members()
                if index is not None:
                    ask(rep, one)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if here is not None and members[0]:
            if index is None:
                index = opened()
                ask_members()
            out += index.forest()
        if out:
            yield batch_of(out)

    order = ["home", "part", F.col("own").desc(), "rep"]
    dealt = rows.repartition("home", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(tidy(work), "node long, links long, peer long")


def recurring(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of (c1, times), sorted, and their counts: at most RECURRING numbers, cut where a grade of counts ends.

    The cut-off is found by counting grades, so what comes to the driver is what is kept."""
    grade = F.floor(F.log2("times") * 8).cast("int")
    levels = sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"])  # a few hundred grades at most
    total, least = 0, None
    for level in levels:
        total += level["count"]
        if total > RECURRING:
            break
        least = level["grade"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    often = counts.filter(grade >= least).toPandas()
    known = often["c1"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(known)
    return known[place], often["times"].to_numpy(np.int64)[place]


def shared_shingles(lists: DataFrame) -> DataFrame:
    """(s, c1, pos, n, m) of the listed shingles that several classes list: once a class, with the number of lists they are on.

    Those known to recur may be on a share of all lists: they are counted before the shuffle, and their table, which has RECURRING
    rows at most, goes to the rows. Others are on few lists and met in one task each."""
    tokens = lists.select("c1", "n", "cold", F.posexplode("s").alias("pos", "s"))
    several_of = "min(c1) OVER (PARTITION BY s) < max(c1) OVER (PARTITION BY s)"
    cold = tokens.filter("pos < cold").select(
        "s", "c1", "pos", "n", F.expr("lag(c1) OVER (PARTITION BY s ORDER BY c1)").alias("_a"),
        F.expr("count(1) OVER (PARTITION BY s)").alias("m"), F.expr(several_of).alias("_several"),
    ).filter("_several AND (_a IS NULL OR _a <> c1)").drop("_a", "_several")
    hot = tokens.filter("pos >= cold")
    keys = hot.groupBy("s").agg(F.min("c1").alias("_a"), F.max("c1").alias("_b"), F.count(F.lit(1)).alias("m")).filter("_a < _b")
    rows = hot.join(F.broadcast(keys.select("s", "m")), "s")
    return cold.unionByName(rows.groupBy("s", "c1").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("m").alias("m")))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, size: int = WORDS, id_col: str = "doc_id", text: str = "text", links: bool = False
) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles and component_id (smallest id reachable by links) of every row; with ``links`` n_links too."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text")
    )
    both = written(scanned(rows, size), "classes")
    seen = both.filter("often IS NULL").drop("often")
    counts = both.filter("often IS NOT NULL").groupBy("c1").agg(F.sum("often").alias("times"))
    order = spark.sparkContext.broadcast(recurring(counts))  # RECURRING numbers at most

    classes = seen.filter("n > 0").groupBy("c1", "c2").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")
    )
    classes = stored(classes.select("c1", "c2", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "copies", "n"))
    reps = classes.filter("rep IS NOT NULL AND n > 1").select("c1", "rep", "mark", "copies")

    lists = written(listed(rows, order, percent, size), "lists")
    # Where two classes had one c1, both would go where either has to.
    shared = written(shared_shingles(lists).join(reps.select("c1", "rep"), "c1").select("s", "rep", "pos", "n", "m"), "shared")
    discard(lists)
    homes = stored(shared.groupBy("rep").agg(F.max(F.struct("m", "s"))["s"].alias("home"), F.max("n").alias("n")))
    parts = stored(homes.groupBy("home").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / INDEX)).cast("int").alias("parts")))

    def search(visits: DataFrame) -> DataFrame:
        """Edges that the visits (rep, home, own, round) find."""
        every = visits.join(parts, "home").groupBy("rep").agg(F.collect_list(F.struct("home", "parts", "own", "round")).alias("visits"))
        wanted = stored(reps.select("rep", "mark", "copies").join(every, "rep"))
        texts = rows.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")
        keys = wanted.select("rep", "mark")
        if keys.count() <= BROADCAST_ROWS:  # then other texts needn't be shuffled
            texts = texts.join(F.broadcast(keys), ["rep", "mark"], "left_semi")
        base = texts.join(wanted, ["rep", "mark"]).dropDuplicates(["rep", "mark"])
        return stored(searched(sent(base, size), percent, links))

    edges = None
    placed = homes.withColumn("comp", F.col("rep"))
    split = homes.join(parts.filter("parts > 1"), "home")
    if not links and not parts.filter("parts > 1").isEmpty():
        bucket = F.pmod(F.xxhash64("rep"), F.lit(LEADERS))
        leaders = split.groupBy("home", bucket.alias("_bucket")).agg(F.min(F.struct(F.xxhash64("rep", "home").alias("_h"), "rep"))["rep"].alias("rep"))
        leads = leaders.select("rep", "home", F.lit(True).alias("_leads"))
        met = split.select("rep", "home").join(leads, ["rep", "home"], "left")
        edges = search(met.select("rep", "home", F.lit(True).alias("own"), F.coalesce("_leads", F.lit(False)).alias("round")))
        early = components(edges.select(F.col("node").alias("a"), F.col("peer").alias("b")))
        placed = homes.join(early.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        placed = stored(placed)
    # The largest component of each home that is split: its classes stay in their parts.
    main = placed.join(split.select("rep"), "rep", "left_semi").groupBy("home", "comp").count()
    main = main.groupBy("home").agg(F.max(F.struct("count", "comp"))["comp"].alias("_main"))

    grade = F.floor(F.log("n") * 8).cast("int")
    graded = placed.select("rep", F.col("home").alias("own"), grade.alias("own_grade"), "comp")
    met = shared.drop("m").join(graded, "rep")
    at = met.groupBy("s", F.col("own").alias("home"), F.col("own_grade").alias("grade")).agg(
        F.min("n").alias("_low"), F.max("n").alias("_high"), F.min("pos").alias("_pos"), F.count(F.lit(1)).alias("_members"),
        F.min("comp").alias("_c1"), F.max("comp").alias("_c2"),
    )
    # A class visits a home where sizes and places leave room for the overlap: at the first shingle that two sets share, what is left of
    # either from there on has to hold it all. And shared shingles past the list of one of the two are fewer than the overlap, so
    # the lists have to share the rest. Of two homes the smaller is visited, unless links are counted.
    sizes = f"(own <> home OR own_grade <> grade OR _members > 1) AND {percent} * n <= 100 * _high AND {percent} * _low <= 100 * n"
    once = "true" if links else "home <= own AND NOT (_c1 = comp AND _c2 = comp)"
    least, whole = f"{percent} * (n + _low)", 100 + percent
    first = f"{least} <= {whole} * (n - pos) AND {least} <= {whole} * (_high - _pos)"
    unlisted = f"greatest(n - {listed_sql('n', percent)}, _top - {listed_sql('_top', percent)})"
    near = (
        met.alias("m").join(at.alias("t"), F.expr(f"m.s = t.s AND {sizes} AND {once}"))
        .groupBy("m.rep", "m.comp", "t.home", "t.grade")
        .agg(F.count(F.lit(1)).alias("_both"), F.max(F.expr(first)).alias("_first"), F.max("n").alias("n"), F.min("_low").alias("_low"), F.max("_high").alias("_top"))
        .filter(f"_first AND {whole} * (_both + {unlisted}) >= {least}")
        .select("rep", "comp", "home", "grade")
    )
    near = written(near, "visits")
    discard(shared)
    # A class lives at its home only where one of its size is looked for.
    asked = near.select("home", "grade").distinct()
    living = graded.join(asked, (F.col("own") == F.col("home")) & (F.col("own_grade") == F.col("grade")))
    living = living.join(main, "home", "left").select("rep", "home", F.lit(True).alias("own"), (F.lit(links) | ~F.col("comp").eqNullSafe(F.col("_main"))).alias("round"))
    visits = living.unionByName(near.select("rep", "home", F.lit(False).alias("own"), F.lit(True).alias("round")))
    visits = visits.groupBy("rep", "home").agg(F.max("own").alias("own"), F.max(F.when(F.col("own"), F.col("round"))).alias("round"))
    found = search(visits.withColumn("round", F.coalesce("round", F.lit(True))))
    discard(near)

    labels = components((found if edges is None else found.unionByName(edges)).select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").drop("node")
    if links:
        named = named.join(counted, F.col("rep") == F.col("node"), "left").drop("node")
    named = named.select(
        "c1", "c2", F.least(F.coalesce("component", "rep"), F.col("rep")).alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if links else F.lit(0).cast("long")).alias("links"),
    )
    full = seen.join(named, ["c1", "c2"], "left")
    return full.select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).alias("n_links")] if links else []),
    )

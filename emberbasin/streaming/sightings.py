"""Keyed stream state: each detection's first sight, and later pulls of it as updates of its age.

``once_per_key`` drops what it has seen. Here nothing is dropped: the state keeps one small row a uid, and every pull of it comes out with its
place in the history. State that no pull has touched for the time-to-live is gone by itself, so it is bounded by the uids of that time.

Uids are dealt by hash to a fixed number of buckets. A call of Python takes a bucket's rows, and the state is a map by uid in each bucket:
what a frame, a call and an output batch cost is paid once a bucket, and a uid costs one read and one write of the map.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Pulls of a detection go on for a week at most.
KEPT_MS = 7 * DAY_MS
#: Part of the state's layout: with another number a checkpoint can't be gone on with.
BUCKETS = 16_384
#: Rows of one bucket that are sorted at a time, at 16 bytes each.
CHUNK_ROWS = 4_000_000
KEY = "uid string"
STATE = "pulls long, first_age double, last_age double"
SIGHTINGS = "uid string, kind string, pull long, hours_old double, first_hours_old double, last_hours_old double"


def known(age: float) -> float | None:
    return None if age != age else float(age)


class Sightings(StatefulProcessor):
    """For each uid the number of pulls, the least age, which is the first sight's, and the greatest."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", KEY, STATE, ttlDurationMs=self.kept_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        numbers: dict[str | None, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for frame in rows:
            uids = [numbers.setdefault(u if isinstance(u, str) else None, len(numbers)) for u in frame["uid"]]
            parts.append((np.array(uids, dtype="int64"), frame["hours_old"].to_numpy(dtype="float64", na_value=np.nan)))
            if sum(len(held) for held, _ in parts) >= CHUNK_ROWS:
                yield from self.pulled(list(numbers), parts)
                numbers, parts = {}, []
        if parts:
            yield from self.pulled(list(numbers), parts)

    def pulled(self, uids: list[str | None], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """The rows of a chunk by uid and age, ages that are not known last, with the state before and after."""
        of, ages = (np.concatenate(held) for held in zip(*parts))
        order = np.lexsort((ages, of))
        of, ages = of[order], ages[order]
        counts = np.bincount(of, minlength=len(uids))
        starts = np.cumsum(counts) - counts
        before = [self.seen.getValue((uid,)) or (0, None, None) for uid in uids]
        pulls = np.array([b[0] for b in before], dtype="int64")
        first, last = (np.array([np.nan if b[i] is None else b[i] for b in before], dtype="float64") for i in (1, 2))
        greatest = np.fmax.reduceat(ages, starts)
        least, most = np.fmin(first, ages[starts]), np.fmax(last, greatest)
        for i, uid in enumerate(uids):
            self.seen.updateValue((uid,), (int(pulls[i] + counts[i]), known(least[i]), known(most[i])))
        pull = pulls[of] + np.arange(len(of)) - starts[of] + 1
        columns = [
            np.array(uids, dtype=object)[of],
            np.where(pull == 1, "first", "update").astype(object),
            pull,
            ages,
            least[of],
            np.fmax(last[of], np.where(np.isnan(ages), greatest[of], ages)),
        ]
        yield pd.DataFrame(dict(zip([c.split()[0] for c in SIGHTINGS.split(", ")], columns)))

    def close(self) -> None:
        """Nothing to let go of."""


def sightings(detections: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """One row a pull: uid, kind ('first' or 'update'), the pull's number, its age, and the least and greatest age so far.

    ``detections`` is a stream with uid and hours_old; the session's state store has to be RocksDB (:data:`PROVIDER`), which
    keeps large state out of the heap. Pulls of a uid within one batch come in the order of their ages; an older
    pull that comes late lowers ``first_hours_old`` from then on. Rows without a uid are one key. A batch that is run again after
    a failure gives the same rows again, as state is committed with the batch.
    """
    bucket = F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).alias("bucket")
    keyed = detections.select(bucket, "uid", "hours_old").groupBy("bucket")
    return keyed.transformWithStateInPandas(
        statefulProcessor=Sightings(kept_ms), outputStructType=SIGHTINGS, outputMode="Append", timeMode="ProcessingTime"
    )


# Executors need pandas for it, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Weights of points in rectangles, counted without making the pairs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle


def group_numbers(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A number for each row, alike for rows that are alike in all columns, in as few numbers as there are such groups."""
    code = np.zeros(len(columns[0]), dtype="int64")
    for column in columns:
        values, place = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + place, return_inverse=True)[1]
    return code


def weights_within(
    points: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, boxes: tuple[np.ndarray, ...]
) -> np.ndarray:
    """For each box the weight of the points of its group inside it, edges included.

    ``points``: group, x, y; ``boxes``: group, least and greatest x, least and greatest y. Points are sorted by group and x, so a box is a
    range of places; of these it wants those with y in range. That is four counts of points before a place and
    below a y, each found in blocks of 1, 2, 4... places that are sorted by y: time grows with (points + boxes) * log(points). NaN
    is the greatest value, as in Spark.
    """
    group, x, y = points
    of, x_low, x_high, y_low, y_high = boxes
    xs, ys = np.unique(x), np.unique(y)
    wide, high = len(xs) + 1, len(ys) + 1
    key = group * wide + np.searchsorted(xs, x)
    order = np.argsort(key, kind="stable")
    key, rank, weight = key[order], np.searchsorted(ys, y)[order], weights[order]
    start = np.searchsorted(key, of * wide + np.searchsorted(xs, x_low))
    end = np.searchsorted(key, of * wide + np.searchsorted(xs, x_high, "right"))
    below, above = np.searchsorted(ys, y_low), np.searchsorted(ys, y_high, "right")
    place, least = np.concatenate([end, start, end, start]), np.concatenate([above, below, below, above])
    sign = np.repeat([1, 1, -1, -1], len(of))
    found = np.zeros(len(place), dtype="int64")
    at = np.arange(len(key))
    for bit in range(int(len(key)).bit_length()):
        block = (at >> bit) * high + rank
        turn = np.argsort(block, kind="stable")
        block, rank, weight = block[turn], rank[turn], weight[turn]
        sums = np.concatenate([[0], np.cumsum(weight)])
        asked = np.flatnonzero(place >> bit & 1)
        number = (place[asked] >> bit) - 1
        found[asked] += sums[np.searchsorted(block, number * high + least[asked])] - sums[number << bit]
    return (found * sign).reshape(4, -1).sum(axis=0)


def counter(cell: Sequence[str], key: str, box: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogrouped points (``cell``, latitude, longitude, points) and boxes (``cell``, ``key``, ``box``): ``key, hits`` of boxes with any."""
    cell, box = list(cell), list(box)

    def count(points: pa.Table, boxes: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy()
        if points.num_rows and boxes.num_rows:
            group = group_numbers([np.concatenate([numbers(points, c), numbers(boxes, c)]) for c in cell])
            at = points.num_rows
            hits = weights_within(
                (group[:at], numbers(points, "latitude"), numbers(points, "longitude")), numbers(points, "points"),
                (group[at:], *[numbers(boxes, c) for c in box]),
            )
        else:
            hits = np.zeros(boxes.num_rows, dtype="int64")
        counted = pa.table({"key": boxes.column(key), "hits": pa.array(hits, pa.int64())}).filter(pa.array(hits > 0))
        return counted.rename_columns([key, "hits"])

    return count


# Executors need numpy and pyarrow for it, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A Hilbert curve over the globe: one number for a position, near for near positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each axis; a cell is about 300 m high and 600 m wide at the equator.
BITS = 16
STEP = 4


def _tables() -> tuple[list[int], list[int]]:
    """For state and STEP bits of both axes: the digits of the curve and the next state.

    A state tells whether axes are swapped (1) and whether both are turned round (2).
    """
    digits, states = [], []
    for state in range(4):
        for cell in range(1 << 2 * STEP):
            x, y = cell >> STEP, cell & ((1 << STEP) - 1)
            at, number = state, 0
            for bit in reversed(range(STEP)):
                a, b = x >> bit & 1, y >> bit & 1
                if at & 1:
                    a, b = b, a
                if at & 2:
                    a, b = 1 - a, 1 - b
                number = 4 * number + (3 * a ^ b)
                if not b:
                    at ^= 1 | 2 * a
            digits.append(number)
            states.append(at)
    return digits, states


DIGITS, STATES = _tables()


def _cell(value: Column, low: float, span: float) -> Column:
    """The value's cell on its axis, held to the ends of the axis."""
    cells = 1 << BITS
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((value - low) / span * cells))).cast("int")


def hilbert_key(latitude: Column, longitude: Column) -> Column:
    """Where the position's cell lies on the curve, as a long; null where a coordinate is null or no number.

    Made of look-ups in two constant arrays, STEP bits at a time, so it stays in generated code.
    """
    x, y = _cell(longitude, -180.0, 360.0), _cell(latitude, -90.0, 180.0)
    digits, states = F.lit(DIGITS), F.lit(STATES)
    key, state = F.lit(0).cast("long"), F.lit(0)
    mask = F.lit((1 << STEP) - 1)
    for shift in reversed(range(0, BITS, STEP)):
        bits = F.shiftright(x, shift).bitwiseAND(mask) * (1 << STEP) + F.shiftright(y, shift).bitwiseAND(mask)
        place = state * (1 << 2 * STEP) + bits + 1
        key = key * (1 << 2 * STEP) + F.element_at(digits, place)
        state = F.element_at(states, place)
    known = latitude.isNotNull() & longitude.isNotNull() & ~F.isnan(latitude) & ~F.isnan(longitude)
    return F.when(known, key)

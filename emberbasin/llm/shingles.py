"""Hashed words and word shingles of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from emberbasin.llm.common import mixed64, string_bytes

WORDS = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
BASES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Sums modulo 2^64 alone are equal for some texts made of two symbols in turn; those modulo a prime aren't.
PRIME = (1 << 31) - 1
PRIME_STEP = 1_103_515_245


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the power of 0, 1, ... and of 0, -1, ..., modulo 2^64."""
    back = np.uint64(pow(int(STEP), -1, 1 << 64))
    up, down = np.full(count, STEP, np.uint64), np.full(count, back, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prime_powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_STEP to the power of 0, 1, ... and of 0, -1, ..., modulo PRIME."""
    out = []
    for base in (PRIME_STEP, pow(PRIME_STEP, -1, PRIME)):
        power = np.ones(count, np.uint64)
        done = 1
        while done < count:
            more = min(done, count - done)
            power[done : done + more] = power[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done += more
        out.append(power)
    return out[0], out[1]


class Hasher:
    """Word hashes of batches; tables are kept between them."""

    def __init__(self) -> None:
        self.values = mixed64(np.arange(1, 257, dtype=np.uint64))
        self.values[65:91] = self.values[97:123]  # A-Z as a-z
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, 9, 10, 11, 12, 13]] = True
        self.codes = np.arange(1, 257, dtype=np.uint64)
        self.codes[65:91] = self.codes[97:123]
        self.reach(1 << 12)

    def reach(self, count: int) -> None:
        self.up, self.down = powers(count)
        self.prime_up, self.prime_down = prime_powers(count)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, case of A-Z aside, and where each text's words start (one more than texts)."""
        data, starts = string_bytes(texts)
        n = len(data)
        if n + 1 > len(self.up):
            self.reach(max(n + 1, 2 * len(self.up)))
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~self.blank[data]
        # A text's first byte starts a word, if it is in one, whatever stands before.
        breaks = np.zeros(n + 1, bool)
        breaks[starts] = True
        begins = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks[: n + 1]))
        begins = begins[begins < n]
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks[: n + 1]))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        found = (sums[ends] - sums[begins]) * self.down[begins]
        terms = self.codes[data] * self.prime_up[:n]  # below 2^40, so as many as 2^24 add up without a remainder
        np.cumsum(terms if n < 1 << 24 else terms % np.uint64(PRIME), out=sums[1:])
        other = (sums[ends] - sums[begins]) % np.uint64(PRIME) * self.prime_down[begins] % np.uint64(PRIME)
        return mixed64(found + (ends - begins).astype(np.uint64) * BASES[0]) ^ mixed64(other + STEP), np.searchsorted(begins, starts)


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one, of its whole sequence."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total = total * BASES[1] + words[k : k + len(total)]
    total = mixed64(total)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            one = np.sort(total[a : b - size + 1])
            if len(one) > 1:
                one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = one * BASES[0] + words[k : k + 1]
            one = mixed64(one)
        else:
            one = np.zeros(0, np.uint64)
        sets.append(one)
    return sets


def sequence_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words, of different kinds (the first has no structure to collide on); without words both are 0."""
    counts = at[1:] - at[:-1]
    longest = int(counts.max(initial=0))
    place = np.arange(len(words)) - np.repeat(at[:-1], counts)
    power = np.multiply.accumulate(np.full(longest + 1, BASES[0], np.uint64))
    out = []
    for terms in (mixed64(words ^ mixed64(place.astype(np.uint64) + np.uint64(1))), words * power[place]):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append(np.where(counts > 0, mixed64(sums[at[1:]] - sums[at[:-1]] + counts.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]

"""Sampled suffix positions for operator 7: which 200-byte strings could repeat, and by what."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

LENGTH = 200
GRAM = 32
STEP = 42
_INDEX_BITS = 22
_LOW = np.uint64((1 << _INDEX_BITS) - 1)
_M = np.uint64(0xA24BAED4963EE407)
_BYTES, _MORE_BYTES = np.random.default_rng(11).integers(0, 2**64, (2, 256), dtype=np.uint64)
_POLYNOMIALS = [(np.uint64(0x9E3779B97F4A7C15), _BYTES), (np.uint64(0xD1342543DE82EF95), _MORE_BYTES)]


def pieces(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts gathered into buffers of at most `most` bytes: (bytes, text numbers, their starts in the buffer, their starts in the text).

    A longer text is cut into stretches that overlap by LENGTH - 1, so that each of its strings starts in just one."""
    parts, numbers, inside, held = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for a in range(0, len(t) - LENGTH + 1, most - LENGTH + 1):
            part = t[a : a + most]
            if held + len(part) > most and parts:
                yield _buffer(parts, numbers, inside)
                parts, numbers, inside, held = [], [], [], 0
            parts.append(part)
            numbers.append(i)
            inside.append(a)
            held += len(part)
    if parts:
        yield _buffer(parts, numbers, inside)


def _buffer(parts, numbers, inside):
    sizes = np.array([len(p) for p in parts])
    return b"".join(parts), np.array(numbers), np.cumsum(sizes) - sizes, np.array(inside)


class Sampled:
    """The sampled positions of a buffer. A string of LENGTH bytes is sampled where its least GRAM-byte hash stands (the leftmost), so equal strings
    are sampled at the same offset: the positions are a cover that follows the content. A run is a stretch of consecutive strings with one sampled position."""

    def __init__(self, data: bytes, starts: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        h, size, factor = _BYTES[raw], 1, _M
        while size < GRAM:  # a polynomial over random byte values, by doubling
            h = h[:-size] * factor + h[size:]
            size *= 2
            factor = np.uint64(pow(int(factor), 2, 1 << 64))
        h = mix(h)
        keyed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, size = LENGTH - GRAM + 1, 1
        least = keyed
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        # strings that start in one text and end in the next are none
        ends = np.append(starts[1:], len(raw))
        valid = np.ones(len(raw) - LENGTH + 1, bool)
        for e in ends[:-1]:
            valid[max(0, e - LENGTH + 1) : e] = False
        at = np.flatnonzero(valid)
        position = (least[at] & _LOW).astype(np.int64)
        first = np.flatnonzero((np.diff(position, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        self.raw, self.hash = raw, h
        self.start = at[first]
        self.count = np.diff(np.append(first, len(at)))
        self.position = position[first]
        self.name = h[self.position]
        self.text = np.searchsorted(starts, self.start, "right") - 1

    def stretches(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen runs cut where the distance from string to sampled position passes a multiple of STEP: (first string, strings, run)."""
        out = []
        for k in range((LENGTH - GRAM) // STEP + 1):
            a = np.maximum(self.start[chosen], self.position[chosen] - (k + 1) * STEP + 1)
            z = np.minimum(self.start[chosen] + self.count[chosen], self.position[chosen] - k * STEP + 1)
            some = a < z
            out.append((a[some], (z - a)[some], chosen[some]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def prefix(self) -> None:
        """Prefix sums by which any string of the buffer is hashed at once, by either of two polynomials with bases and byte values of their own."""
        from .common import _power_tables

        self._sums = []
        for base, values in _POLYNOMIALS:
            power, undo = _power_tables(len(self.raw) + 1, base)
            sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(values[self.raw] * power[:-1], out=sums[1:])
            self._sums.append((sums, undo))

    def hashed(self, a: np.ndarray, z: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the bytes from a to z by the polynomial `which`, 0 or 1."""
        sums, undo = self._sums[which]
        return mix((sums[z] - sums[a]) * undo[a] + (z - a).astype(np.uint64) * _M)

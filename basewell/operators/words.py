"""Windows of k bases in Arrow batches of sequences, as numbers: arrays over many sequences at once, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.params import IndexParams

#: Bases of a block, and bytes that its windows take at most as text.
BLOCK, TEXT = 1 << 16, 1 << 22
_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)
_LETTERS, _TURNED = np.frombuffer(b"ACGTN", np.uint8), np.frombuffer(b"TGCAN", np.uint8)


@dataclass
class Block:
    """codes: 0 to 3 for A C G T, else 4, of a part of a batch's bases from `low` on; ok: whether a window over A C G T of one sequence starts at a place."""

    k: int
    codes: np.ndarray
    ok: np.ndarray
    low: int
    ids: pa.Array
    begins: np.ndarray
    ends: np.ndarray
    starts: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The sequence, by its place in the batch, in which a window starts."""
        return np.searchsorted(self.ends, at + self.low, "right")

    def placed(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """ref_id and pos of windows."""
        row = self.rows(at)
        return self.ids.take(pa.array(row)), pa.array(self.starts[row] + (at + self.low - self.begins[row]))

    def text(self, at: np.ndarray, turned: bool = False) -> pa.Array:
        """Windows as words, or as their reverse complements."""
        size = len(self.codes)
        letters = _TURNED[self.codes[::-1]] if turned else _LETTERS[self.codes]
        views = np.lib.stride_tricks.sliding_window_view(letters, self.k)
        return strings(views[size - self.k - at if turned else at])


def strings(letters: np.ndarray) -> pa.Array:
    """A row of letters each as a string."""
    n, k = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def _flat(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and where each begins; characters of several bytes become one that is no base."""
    kind = np.int64 if pa.types.is_large_string(seq.type) else np.int32
    buffers = seq.buffers()
    offsets = np.frombuffer(buffers[1], kind)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64) if len(seq) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) and data.max() > 127:
        plain = [(x or "").encode("ascii", "replace") for x in seq.to_pylist()]
        return np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, k: int, size: int = BLOCK) -> Iterator[Block]:
    """The windows of a batch (ref_id, start, seq) in blocks, each window in one of them."""
    data, offsets = _flat(batch.column("seq"))
    begins, ends, starts = offsets[:-1], offsets[1:], batch.column("start").to_numpy(zero_copy_only=False)
    for low in range(0, len(data) - k + 1, size):
        codes = _CODES[data[low : low + size + k - 1]]
        m = len(codes) - k + 1
        bad = np.flatnonzero(codes == 4)
        cut = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, low + len(codes), "left")] - low
        ok = np.ones(m, bool)
        if len(bad) or len(cut):  # a window must not reach a letter that is no base, nor over a sequence's end
            first, after = np.concatenate([bad, cut - 1]) - k + 1, np.concatenate([bad + 1, cut])
            first[len(bad) :] += 1
            marks = np.bincount(np.clip(first, 0, m), minlength=m + 1) - np.bincount(np.clip(after, 0, m), minlength=m + 1)
            ok = np.cumsum(marks)[:m] == 0
        yield Block(k, codes, ok, low, batch.column("ref_id"), begins, ends, starts)


def whole_rows(batch: pa.RecordBatch, bases: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bases, or a sequence each if they are longer."""
    ends = np.cumsum(pc.binary_length(batch.column("seq")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + bases, "right")))
        yield batch.slice(first, last - first)
        first = last


def counts_and_rows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different lesser strands of a block's windows, how often each occurs, and in how many of its sequences that have a ref_id."""
    key, row = least(block), block.rows(np.flatnonzero(block.ok))
    found, n = np.unique(key, return_counts=True)
    if block.ids.null_count:
        known = block.ids.is_valid().to_numpy(zero_copy_only=False)[row]
        key, row = key[known], row[known]
    bits = 2 * block.k
    if len(row) and int(row[-1]).bit_length() + bits < 64:
        pairs = np.sort(row << bits | key)
        own = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] & (1 << bits) - 1
    else:
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        own = key[np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))]
    held, m = np.unique(own, return_counts=True)
    refs = np.zeros(len(found), np.int64)
    refs[np.searchsorted(found, held)] = m
    return found, n, refs


def _parts(codes: np.ndarray, n: int, turned: bool) -> np.ndarray:
    kind = np.uint64 if n > 16 else np.uint32
    power, size, found, have = (3 - (codes & 3) if turned else codes & 3).astype(kind), 1, None, 0
    while True:
        if n & size:
            if found is None:
                found = power
            elif turned:  # the later part of a strand is the earlier one of the other
                found = found[: len(power) - have] | power[have:] << kind(2 * have)
            else:  # `found` is of fewer bases than `power`, which therefore goes first
                found = power[: len(found) - size] << kind(2 * have) | found[size:]
            have += size
        size *= 2
        if size > n:
            return found
        half = size // 2
        power = power[half:] << kind(2 * half) | power[:-half] if turned else power[:-half] << kind(2 * half) | power[half:]


def ahead(codes: np.ndarray, n: int) -> np.ndarray:
    """The numbers of all words of n bases (1 to 32); of those with other letters none that means anything."""
    return _parts(codes, n, False)


def back(codes: np.ndarray, n: int) -> np.ndarray:
    """The numbers of their reverse complements."""
    return _parts(codes, n, True)


def least(block: Block) -> np.ndarray:
    """The lesser strand's number of every window over A C G T."""
    return np.minimum(ahead(block.codes, block.k), back(block.codes, block.k))[block.ok].astype(np.int64)


def decoded(numbers: np.ndarray, n: int) -> np.ndarray:
    """The letters of numbered words, a row each."""
    return _LETTERS[np.stack([(numbers >> 2 * (n - 1 - i)).astype(np.uint8) & 3 for i in range(n)], axis=1)]


def _syncmers(key: np.ndarray, p: IndexParams) -> np.ndarray | None:
    if p.s in (0, p.c):
        return None
    smer = lambda i: key >> key.dtype.type(2 * (p.c - p.s - i)) & key.dtype.type(4**p.s - 1)
    ends, between = np.minimum(smer(0), smer(p.c - p.s)), [smer(i) for i in range(1, p.c - p.s)]
    closed = np.ones(len(key), bool)
    for x in between:
        closed &= ends <= x
    return closed


def keyed(block: Block, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose core is a closed syncmer, the keys of all windows, and whether the forward strand is taken.

    Oriented by core: the strand with the lesser core, the reverse if equal; or by the whole window."""
    m, half = len(block.ok), p.f // 2
    if p.orient == "core":
        a, b = (f(block.codes, p.c)[half : half + m] for f in (ahead, back))
        key = np.minimum(a, b)
    else:
        a, b = ahead(block.codes, p.k), back(block.codes, p.k)
        key = np.minimum(a, b) >> a.dtype.type(p.f) & a.dtype.type(4**p.c - 1)
    closed = _syncmers(key, p)
    return np.flatnonzero(block.ok if closed is None else block.ok & closed), key, a < b


def flanks(block: Block, p: IndexParams, at: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """The numbered flanks of windows, left then right, of the strand that is taken."""
    half = p.f // 2
    if not half:
        return np.zeros(len(at), np.int64)
    a, b, far = ahead(block.codes, half).astype(np.int64), back(block.codes, half).astype(np.int64), at + half + p.c
    return np.where(forward[at], a[at] << p.f | a[far], b[far] << p.f | b[at])

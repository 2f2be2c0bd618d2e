"""An index in (key, ref_id, pos) order: one shuffle of packed occurrences to ranges of bounded size, which are sorted in memory.

The bounds come from the keys' counts, so ranges are even however the keys are spread; a key of more occurrences than a range is cut by (ref_id, pos). Packed occurrences take 3 to 8 bytes each."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from . import running

#: Occurrences of a range, those that a task packs together, rows of a batch that goes back to Spark, and places that are sampled of a frequent key per range that it fills.
RANGE, PACKED, ROWS, SAMPLED = 1 << 20, 1 << 21, 1 << 16, 64


@dataclass
class Bounds:
    """firsts: the first key of each span of keys, in order; ids: the number of its first range. cuts: by key, of a key of several ranges, the (ref_id, pos) at which the later ones begin;
    befores: how many of its occurrences stand before each of them; counts: how many it has in all."""

    firsts: np.ndarray
    ids: np.ndarray
    cuts: dict[int, list[tuple[int, int]]]
    befores: dict[int, list[int]]
    counts: dict[int, int]

    def ranges(self, key: np.ndarray, ref: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The range of each occurrence."""
        found = self.ids[np.searchsorted(self.firsts, key, "right") - 1]
        for k, cuts in self.cuts.items():
            at = np.flatnonzero(key == k)
            if len(at):
                found[at] += _after(cuts, ref[at], pos[at])
        return found

    def span(self, number: int) -> int | None:
        """The key that fills a range alone, if it goes on in others."""
        first = int(self.firsts[bisect_right(self.ids.tolist(), number) - 1])
        return first if first in self.cuts else None


def _after(cuts: list[tuple[int, int]], ref: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """How many of the cuts, in order, each place has reached."""
    refs, places = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    low, high = np.searchsorted(refs, ref, "left"), np.searchsorted(refs, ref, "right")
    for a in np.unique(low[low < high]):
        at = np.flatnonzero((low == a) & (high > a))
        low[at] += np.searchsorted(places[a : high[at[0]]], pos[at], "right")
    return low


def bounds(index: DataFrame, every: DataFrame, size: int = RANGE) -> Bounds:
    """Of index(key, ref_id, pos, ...) whose keys have the counts every(key, n). A row per range comes to the driver, as for any sort by ranges; of keys that fill several, some places per range, too."""
    every = store.written(every.select("key", "n"))
    hot = {r["key"]: r["n"] for r in every.filter(F.col("n") > size).collect()}  # fewer than ranges
    spans = running.sums(every, ["key"], "n").groupBy(F.floor(F.col("n_before") / size)).agg(F.min("key").alias("key")).collect()
    firsts = sorted({-(1 << 63), *(r["key"] for r in spans), *hot, *(k + 1 for k in hot)})
    cuts: dict[int, list[tuple[int, int]]] = {}
    if hot:
        only = index.filter(F.col("key").isin(list(hot)))
        for r in only.sample(min(1.0, SAMPLED / size), seed=1).select("key", "ref_id", "pos").collect():
            if r["ref_id"] is not None:
                cuts.setdefault(r["key"], []).append((r["ref_id"], r["pos"]))
        for k in list(cuts):
            seen, parts = sorted(set(cuts[k])), -(-hot[k] // size)
            cuts[k] = sorted({seen[len(seen) * i // parts] for i in range(1, parts)})
    widths = [len(cuts.get(k, ())) + 1 for k in firsts]
    made = Bounds(np.array(firsts, np.int64), np.concatenate([[0], np.cumsum(widths[:-1])]).astype(np.int64), cuts, {}, {k: hot[k] for k in cuts})
    if cuts:
        cut_of = dict(cuts)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                key, ref, pos = (x.values for x in _columns(batch, ("key", "ref_id", "pos")))
                for k, places in cut_of.items():
                    at = np.flatnonzero(key == k)
                    for i, n in enumerate(np.bincount(_after(places, ref[at], pos[at])).tolist() if len(at) else ()):
                        total[k, i] = total.get((k, i), 0) + n
            yield pa.RecordBatch.from_pylist([{"key": k, "i": i, "n": n} for (k, i), n in total.items()], pa.schema([("key", pa.int64()), ("i", pa.int64()), ("n", pa.int64())]))

        for k, places in cuts.items():
            made.befores[k] = [0] * (len(places) + 1)
        for r in only.select("key", "ref_id", "pos").mapInArrow(counted, "key long, i long, n long").groupBy("key", "i").agg(F.sum("n").alias("n")).collect():
            for later in range(r["i"] + 1, len(made.befores[r["key"]])):
                made.befores[r["key"]][later] += r["n"]
    return made


@dataclass
class Column:
    """Numbers; where they are null (missing), which goes last, any number stands."""

    values: np.ndarray
    missing: np.ndarray | None = None


#: What stands for a null, so nulls are last in order.
_LAST = (1 << 63) - 1


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[Column]:
    out = []
    for name in names:
        x = batch.column(name)
        out.append(Column(x.to_numpy(zero_copy_only=False)) if not x.null_count else Column(x.fill_null(_LAST).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)))
    return out


def _joined(columns: list[Column]) -> Column:
    missing = None
    if any(c.missing is not None for c in columns):
        missing = np.concatenate([np.zeros(len(c.values), bool) if c.missing is None else c.missing for c in columns])
    return Column(np.concatenate([c.values for c in columns]), missing)


def _put(values: np.ndarray) -> bytes:
    """Numbers less their least, in as many bytes as the largest takes, byte by byte of all numbers."""
    least = int(values.min())
    rest = values.view(np.uint64) - np.uint64(least & (1 << 64) - 1)  # modulo 2**64
    most = int(rest.max())
    width = next(w for w in (0, 1, 2, 4, 8) if most < 1 << 8 * w)
    planes = rest.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes() if width else b""
    return struct.pack("<qb", least, width) + planes


def _take(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    least, width = struct.unpack_from("<qb", data, at)
    at += 9
    if not width:
        return np.full(n, least, np.int64), at
    planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    rest = np.ascontiguousarray(planes).view(f"<u{width}").reshape(n).astype(np.uint64)
    return (rest + np.uint64(least & (1 << 64) - 1)).view(np.int64), at + n * width


def pack(columns: list[Column]) -> bytes:
    """Columns of equal length as bytes; the second (ref_id) as steps, which are mostly none."""
    parts = [struct.pack("<q", len(columns[0].values))]
    for i, c in enumerate(columns):
        values = np.ascontiguousarray(c.values, np.int64)
        parts.append(_put(np.concatenate([values[:1], np.diff(values.view(np.uint64)).view(np.int64)]) if i == 1 else values))
        parts.append(b"\0" if c.missing is None else b"\1" + np.packbits(c.missing).tobytes())
    plain = b"".join(parts)
    return struct.pack("<q", len(plain)) + pa.compress(plain, "zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[Column]:
    data = memoryview(pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], "zstd"))
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for i in range(columns):
        values, at = _take(data, at, n)
        if i == 1:
            values = np.cumsum(values.view(np.uint64)).view(np.int64)
        missing, at = None if not data[at] else np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 1), count=n).astype(bool), at + 1 + (-(-n // 8) if data[at] else 0)
        out.append(Column(values, missing))
    return out


def _order(key: Column, ref: Column, pos: Column) -> np.ndarray:
    """Of (key, ref_id, pos), as one number where their ranges fit 63 bits."""
    word, bits = np.zeros(len(key.values), np.int64), 0
    if ref.missing is None:
        for c in (key, ref, pos):
            least, most = int(c.values.min()), int(c.values.max())
            bits += (width := (most - least).bit_length())
            if bits > 63:
                break
            word = word << width | c.values - least
        else:
            return np.argsort(word, kind="stable")
    return np.lexsort((pos.values, ref.values, np.zeros(len(word), bool) if ref.missing is None else ref.missing, key.values))


@dataclass
class Range:
    """A sorted range: key, n (of the key), slot (an occurrence's place in its key's, from 0), and the columns asked for, ref_id and pos first."""

    key: np.ndarray
    n: np.ndarray
    slot: np.ndarray
    columns: dict[str, Column]

    def array(self, name: str, a: int, z: int) -> pa.Array:
        """A part of a column."""
        c = self.columns[name]
        return pa.array(c.values[a:z], mask=None if c.missing is None else c.missing[a:z])


def each(index: DataFrame, every: DataFrame, names: tuple[str, ...], made: Callable[[Range], Iterator[pa.RecordBatch]], schema: str, size: int | None = None, least: int | None = None) -> tuple[DataFrame, bool]:
    """What `made` gives of each sorted range of the index, and whether some key goes over several ranges. names: ref_id, pos, and further columns of whole numbers. Flanks are null where a key has at most
    `least` occurrences."""
    limits, names = bounds(index, every, size or RANGE), ("key", *names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            columns = [_joined([h[i] for h in held]) for i in range(len(names))]
            of = limits.ranges(*(c.values for c in columns[:3]))
            kind = np.uint16 if of.max() < 1 << 16 else np.int64  # the former are sorted by their digits
            order = np.argsort(of.astype(kind), kind="stable")
            of = of[order]
            stops = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            ids, blobs, bytes_held = [], [], 0
            for a, z in zip(stops[:-1], stops[1:], strict=True):
                at = order[a:z]
                ids.append(int(of[a]))
                blobs.append(pack([Column(c.values[at], None if c.missing is None else c.missing[at]) for c in columns]))
                bytes_held += len(blobs[-1])
                if bytes_held > 1 << 22 or z == len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "blob"])
                    ids, blobs, bytes_held = [], [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(_columns(batch, names))
                rows += batch.num_rows
            if rows >= PACKED:
                yield from dealt()
                held, rows = [], 0
        if rows:
            yield from dealt()

    def opened(number: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, len(names)) for batch in batches for x in batch.column("blob").to_pylist()]
        key, ref, pos, *more = (_joined([p[i] for p in parts]) for i in range(len(names)))
        del parts
        order = _order(key, ref, pos)
        keys = key.values[order]
        stops = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(stops)
        n, slot = np.repeat(sizes, sizes), np.arange(len(keys)) - np.repeat(stops[:-1], sizes)
        whole = limits.span(number[0].as_py())
        if whole is not None:
            place = number[0].as_py() - int(limits.ids[np.searchsorted(limits.firsts, whole, "right") - 1])
            n, slot = np.full(len(keys), limits.counts[whole]), slot + limits.befores[whole][place]
        columns = {name: Column(c.values[order], None if c.missing is None else c.missing[order]) for name, c in zip(names[1:], (ref, pos, *more), strict=True)}
        if least is not None and "flank" in columns:
            few = n <= least
            columns["flank"] = Column(columns["flank"].values, few if columns["flank"].missing is None else few | columns["flank"].missing)
        del key, ref, pos, more, order
        yield from made(Range(keys, n, slot, columns))

    dealt_out = index.select(*[F.col(c).cast("long") for c in names]).mapInArrow(packed, "range long, blob binary").groupBy("range")
    return dealt_out.applyInArrow(opened, schema), bool(limits.cuts)


def ordered(index: DataFrame, every: DataFrame, *more: str, size: int | None = None, least: int | None = None) -> DataFrame:
    """key, n, slot, ref_id, pos and more columns of whole numbers of the index; rows of a key stand in (ref_id, pos) order. n is counted here, unless it is one of those columns."""
    own = ["key", "slot"] if "n" in more else ["key", "n", "slot"]

    def made(r: Range) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(r.key), ROWS):
            part = [pa.array(getattr(r, c)[i : i + ROWS]) for c in own] + [r.array(c, i, i + ROWS) for c in r.columns]
            yield pa.RecordBatch.from_arrays(part, names=[*own, *r.columns])

    names = ("ref_id", "pos", *more)
    found = each(index, every, names, made, ", ".join(f"{c} long" for c in (*own, *names)), size, least)[0]
    return found.select(*own, *[F.col(c).cast(index.schema[c].dataType) for c in names])


def paged(index: DataFrame, every: DataFrame, page: int, columns: Callable[[Range, int, int], dict[str, pa.Array]], kinds: dict[str, str], size: int | None = None, least: int | None = None, more: tuple[str, ...] = ("flank",)) -> DataFrame:
    """key, n, page (from 0), and for each of the columns, which are made of a part of a range, the values of at most `page` occurrences in (ref_id, pos) order: as an array of the given kind or, where the
    kind is a separator, as text. Pages that two ranges share are joined."""

    def made(r: Range) -> Iterator[pa.RecordBatch]:
        at = r.slot // page
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(r.key) != 0) | (np.diff(at) != 0)]))
        stops = np.concatenate([begins, [len(at)]])
        first = 0
        while first < len(begins):  # as many pages as fill a batch
            last = max(first + 1, int(np.searchsorted(stops, stops[first] + ROWS, "right")) - 1)
            a, z, heads = stops[first], stops[last], begins[first:last]
            offsets = pa.array((stops[first : last + 1] - a).astype(np.int32))
            lists = {c: pa.ListArray.from_arrays(offsets, x) for c, x in columns(r, a, z).items()}
            lists = {c: x if kinds[c].isalpha() else pc.binary_join(x, kinds[c]) for c, x in lists.items()}
            whole = np.diff(offsets.to_numpy()) == np.minimum(r.n[heads] - at[heads] * page, page)
            n = r.columns["n"].values if "n" in r.columns else r.n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.key[heads], n[heads], at[heads], r.slot[heads], whole)] + list(lists.values()), names=["key", "n", "page", "slot", "whole", *lists])
            first = last

    given = ", ".join(f"{c} {f'array<{kind}>' if kind.isalpha() else 'string'}" for c, kind in kinds.items())
    found, shared = each(index, every, ("ref_id", "pos", *more), made, f"key long, n long, page long, slot long, whole boolean, {given}", size, least)
    if not shared:
        return found.drop("slot", "whole")
    parts = found.filter(~F.col("whole")).groupBy("key", "n", "page").agg(F.array_sort(F.collect_list(F.struct("slot", *kinds))).alias("v"))
    each_of = lambda c: F.transform("v", lambda x: x[c])
    joined = [(F.flatten(each_of(c)) if kind.isalpha() else F.array_join(each_of(c), kind)).alias(c) for c, kind in kinds.items()]
    return found.filter("whole").drop("slot", "whole").unionByName(parts.select("key", "n", "page", *joined))

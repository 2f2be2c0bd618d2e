"""Operator 7: removal of byte strings of LENGTH (200) that start anywhere else, within documents or across them.

The difference-cover idea, with a cover that follows the content (a string synchronising set): suffixes are
sampled at content-chosen positions, the sampled ones are named and the names counted, names that stand alone end there, and the
strings before a sampled position are settled from its name and the bytes on both sides, coarse to fine:

1. names of sampled positions (32 bytes) that stand more than once, by a count over all of them;
2. around these, stretches of up to 42 neighbouring strings: their common core (158 bytes) and whole extent (241
   bytes at most) are named; a stretch whose extent stands twice is repeated throughout;
3. where different extents share a core, every single string of the stretch is named and counted.

A plain difference-cover order of all byte suffixes sorts rows for 2/3 of all bytes on its first level alone; the
README has the figures. `difference_cover` has that algorithm for symbol tables.

Names are hashes of 64 bits, compared as pairs (core and extent, core and string) of which the second comes from a polynomial with another base and other
byte values, so that two different strings pass for equal only if they collide in both: about 2**-64 for each, so long as strings aren't made to collide. (Polynomials modulo 2**64
have structured collisions, but of more than 1,000 bytes; these strings have 241 at most.)

Names that must be looked up in a scan go to it as Bloom filters of bounded size: names are dealt to groups of about MOST_KEYS, and a group is worked through before the next one's filters are made. A core has the group of its
sampled position's name, so each group takes two scans, with at most two filters in memory. What a filter lets through by chance is counted exactly later.

Defined results: null texts are empty; texts of fewer than 200 bytes keep everything. Equal rows repeat each other, so both lose what
can be lost. A null doc_id stays null. Very long texts are cut into overlapping pieces of 256 KB. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .repeats import LENGTH, STEP, Sampled, pieces

#: Names per Bloom filter, at 16 bits each: 32 MB.
MOST_KEYS = 1 << 24
_U = np.uint64


class Bloom:
    """A filter over 64-bit names: three bits each in a table of a power of two bits."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(names: np.ndarray, bits: int) -> list[np.ndarray]:
        a, b = common.mix(names), common.mix(names + _U(0x9E3779B97F4A7C15)) | _U(1)
        return [(a + _U(i) * b) & _U(bits - 1) for i in range(3)]

    def holds(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), bool)
        for p in self.places(names, self.bits):
            out &= (self.words[p >> _U(6)] >> (p & _U(63))) & _U(1) == 1
        return out

    @classmethod
    def of(cls, names: DataFrame, n: int) -> Bloom:
        """Of the column `name` of n rows; only the table's words come to the driver."""
        bits = 1 << max(10, (16 * max(1, n) - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.concatenate(cls.places(batch.column("name").to_numpy().astype(_U), bits))
                order = np.argsort(p)
                word, mask = p[order] >> _U(6), _U(1) << (p[order] & _U(63))
                first = np.flatnonzero(np.diff(word.astype(np.int64), prepend=-1))
                if len(first):
                    yield pa.RecordBatch.from_pydict({"word": pa.array(word[first].astype(np.int64)), "mask": pa.array(np.bitwise_or.reduceat(mask, first).astype(np.int64))})

        found = names.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits >> 6, _U)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(_U)
        return cls(bits, words)


def _filter(names: DataFrame):
    """A broadcast filter of the names."""
    return names.sparkSession.sparkContext.broadcast(Bloom.of(names, names.count()))


def _chosen(names: np.ndarray, group: int, groups: int, found: Bloom) -> np.ndarray:
    ok = found.holds(names)
    return ok & (names.astype(np.int64) % groups == group) if groups > 1 else ok


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _names(docs: DataFrame) -> DataFrame:
    """Sampled positions' names, counted by buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for data, _, starts, _ in pieces(_raws(batch)):
                names, n = np.unique(Sampled(data, starts).name, return_counts=True)
                yield pa.RecordBatch.from_pydict({"name": pa.array(names.astype(np.int64)), "n": pa.array(n)})

    return docs.mapInArrow(run, "name long, n long")


def _named(s: Sampled, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the chosen runs' stretches: first string, strings, core name, extent name."""
    s.prefix()
    a, n, run = s.stretches(chosen)
    before = s.position[run] - a
    k = before // STEP
    start = s.position[run] - k * STEP
    core = s.hashed(start, start - STEP + 1 + LENGTH, 0) + k.astype(_U)
    extent = common.mix(s.hashed(a, a + n - 1 + LENGTH, 1) + before.astype(_U) * _U(0x9E3779B97F4A7C15) + n.astype(_U))
    return a, n, core, extent, run


def _stretches(docs: DataFrame, group: int, groups: int, found) -> DataFrame:
    """doc_id, _h, core, extent, a (first string's byte in the text) and n (strings) of the stretches around names that repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for data, numbers, starts, inside in pieces(_raws(batch)):
                s = Sampled(data, starts)
                chosen = np.flatnonzero(_chosen(s.name, group, groups, found.value))
                if not len(chosen):
                    continue
                a, n, core, extent, r = _named(s, chosen)
                t = s.text[r]
                own = pa.array(numbers[t])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("_h").take(own), pa.array(core.astype(np.int64)), pa.array(extent.astype(np.int64)), pa.array(a - starts[t] + inside[t]), pa.array(n.astype(np.int32))], names=["doc_id", "_h", "core", "extent", "a", "n"])

    return docs.mapInArrow(run, f"doc_id {kind}, _h long, core long, extent long, a long, n int")


def _strings(docs: DataFrame, group: int, groups: int, first, second) -> DataFrame:
    """core, extent, strings (names of all strings) of the stretches of a group whose core is looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for data, _, starts, _ in pieces(_raws(batch)):
                s = Sampled(data, starts)
                chosen = np.flatnonzero(_chosen(s.name, group, groups, first.value))
                if not len(chosen):
                    continue
                a, n, core, extent, _ = _named(s, chosen)
                some = np.flatnonzero(second.value.holds(core))
                some = some[np.unique(np.stack([core[some], extent[some]]), axis=1, return_index=True)[1]] if len(some) else some
                if not len(some):
                    continue
                a, n = a[some], n[some]
                at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = s.hashed(at, at + LENGTH, 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(core[some].astype(np.int64)), pa.array(extent[some].astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(each))], names=["core", "extent", "strings"])

    return docs.mapInArrow(run, "core long, extent long, strings array<long>")


def _settled(docs: DataFrame, names: DataFrame, group: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """(stretches, verdict) of one group of repeated names: doc_id, _h, core, extent, a, n; and core, extent, mask."""
    first = _filter(names.filter(F.pmod("name", F.lit(groups)) == group))
    found = common.cut(_stretches(docs, group, groups, first))
    common.release(docs.sparkSession)
    extents = common.cut(found.groupBy("core", "extent").agg(F.count("*").alias("times")))
    cores = common.cut(extents.groupBy("core").agg(F.count("*").alias("extents")).filter("extents > 1").select(F.col("core").alias("name")))
    second = _filter(cores)
    common.release(docs.sparkSession)
    single = common.cut(_strings(docs, group, groups, first, second).dropDuplicates(["core", "extent"]).select("core", "extent", F.posexplode("strings").alias("i", "string")))
    first.destroy()
    second.destroy()
    common.release(docs.sparkSession)
    often = single.groupBy("core", "string").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    masks = single.join(often, ["core", "string"]).groupBy("core", "extent").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    whole = extents.filter("times > 1").select("core", "extent", F.lit(-1).cast("long").alias("mask"))
    verdict = common.cut(whole.unionByName(masks).groupBy("core", "extent").agg(F.bit_or("mask").alias("mask")))
    common.discard(extents, cores, single)
    common.release(docs.sparkSession)
    return found, verdict


def repeated(docs: DataFrame, most_keys: int = MOST_KEYS) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, the tables that they are read from): doc_id, _h, a, n, mask: stretches of n strings from byte a on, of which those in the mask (bit i: string a + i) start elsewhere too. docs(doc_id, text, _h)."""
    names = common.cut(_names(docs).groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name"))
    groups = max(1, -(-names.count() // most_keys))
    settled = [_settled(docs, names, g, groups) for g in range(groups)]
    common.discard(names)
    rows = [found.join(verdict, ["core", "extent"]).select("doc_id", "_h", "a", "n", "mask") for found, verdict in settled]
    return reduce(DataFrame.unionByName, rows), [t for pair in settled for t in pair]


def _merged(marks: DataFrame) -> DataFrame:
    """_d, _g, spans: the removed runs [from, to) of each document, flattened."""
    kind = marks.schema["_d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for marks in batch.column("marks").to_pylist():
                at = np.array([m["a"] for m in marks])
                bits = np.unpackbits(np.array([m["mask"] for m in marks], "<i8").view(np.uint8), bitorder="little").reshape(len(marks), 64)
                bits &= np.arange(64) < np.array([m["n"] for m in marks])[:, None]
                start = np.sort((at[:, None] + np.arange(64))[bits > 0])
                apart = np.flatnonzero(np.diff(start) > LENGTH)
                spans.append(np.stack([start[np.append(0, apart + 1)], start[np.append(apart, len(start) - 1)] + LENGTH], axis=1).reshape(-1) if len(start) else start)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_g"), pa.array(spans, pa.list_(pa.int64()))], names=["_d", "_g", "spans"])

    return marks.mapInArrow(run, f"_d {kind}, _g long, spans array<long>")


def dedupe(docs: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (removed runs [from, to), flattened) and kept (the remaining bytes)."""
    slim = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("_h", F.xxhash64("text"))
    marks, used = repeated(slim, most_keys)
    listed = marks.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.collect_list(F.struct("a", "n", "mask")).alias("marks"))
    spans = common.cut(_merged(listed))
    common.discard(*used)
    common.release(docs.sparkSession)
    both = slim.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for raw, spans in zip(_raws(batch), batch.column("spans").to_pylist(), strict=True):
                edges = [0, *(spans or ()), len(raw)]
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(edges[2:-1:2]) - sum(edges[1:-1:2]))
                out["n_spans"].append(len(edges) // 2 - 1)
                out["spans"].append(edges[1:-1])
                out["kept"].append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.int64()), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], t) for k, t in types.items())], names=["doc_id", *types])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


ORACLE_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as bytes from d),
s as (select doc_id, i, md5(substr(h, cast(2 * i + 1 as bigint), 400)) as m from (select doc_id, h, unnest(range(0, bytes - 199)) as i from n where bytes >= 200)),
again as (select m from s group by m having count(*) > 1),
hit as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from s where m in (select m from again)),
numbered as (select doc_id, i, sum(case when before is null or i - before > 200 then 1 else 0 end) over (partition by doc_id order by i) as k from hit),
span as (select doc_id, k, min(i) as a, max(i) + 200 as z from numbered group by doc_id, k),
gap as (select span.doc_id, k, a, z, coalesce(lag(z) over (partition by span.doc_id order by k), 0) as left_off from span),
piece as (
  select gap.doc_id, k, substr(h, cast(2 * left_off + 1 as bigint), cast(2 * (a - left_off) as bigint)) as x from gap join n on n.doc_id = gap.doc_id
  union all
  select n.doc_id, 1000000000, substr(h, cast(2 * coalesce(e.z, 0) + 1 as bigint)) from n left join (select doc_id, max(z) as z from span group by doc_id) as e on e.doc_id = n.doc_id
),
kept as (select doc_id, string_agg(x, '' order by k) as x from piece group by doc_id),
gone as (select doc_id, count(*) as c, sum(z - a) as b from span group by doc_id)
select n.doc_id, n.bytes as n_bytes, cast(coalesce(gone.b, 0) as bigint) as n_removed, coalesce(gone.c, 0) as n_spans, sha256(unhex(kept.x)) as kept_sha256
from n join kept on kept.doc_id = n.doc_id left join gone on gone.doc_id = n.doc_id
"""

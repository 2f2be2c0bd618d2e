"""Operator 5: mixing sources to target weights.

Words ([^ \\t-\\r]+) of each source, in the order of (bucket, doc_id), are packed into blocks of
`block_words`. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the corpus's
size; a target stops at `most` times its source's size and the excess is shared again by weight. A
source's target fills slots: whole epochs over its blocks, then part of one more, whose last
slot is trimmed, so that the words taken are the target rounded.

The mix is written in output shards of about `slots_per_shard` slots. Each shard's source counts are drawn from the multinomial distribution of the
sources' shares, given that all slots are dealt in the end: a tree over the shards halves each source's slots by binomial draws, from
seeds of its own at each node, so any part of the shards can be drawn anywhere, without the others. A shard holds the next slots of each source, as many as were drawn;
slot j holds the block that the epoch's pseudorandom permutation (a Feistel network, walked into range) gives to j, and blocks are joined by index.
So the draw decides which documents stand in which shard, and `mixed` gives its rows shard by shard, in an order of the slots that mixes sources.
No document is taken more than ceil(target / size) <= `most` times in any part.

Everything is seeded by `seed`, source and epoch: reruns agree. Offsets are prefix sums in two levels (256 buckets
per source, then the documents of a bucket), so a source with a third of all rows is spread.

Defined results: null or empty texts have size 0 and are never taken; an empty source's target is 0;
a null source is a source of its own, after the others. Equal rows are laid out one after the other, those that differ in other columns
in the order of these. Very long texts
are cut at blocks like others. Extra columns are ignored by `taken` and kept by `mixed`. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 2048
#: Slots, about, that one row carries before they are made.
SLOTS_PER_ROW = 65536
MOST = 3
SEED = 20240501
_WORD = r"[^\x20\x09-\x0D]+"


def _key(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n) at `index`: four Feistel rounds over the least even power of two >= n; values >= n walk on."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))

    def scrambled(x: np.ndarray, r: int) -> np.ndarray:
        """SplitMix64 (public domain) of the half with the round's key."""
        h = x + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(31))) & mask

    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            if inverse:
                left, right = right ^ scrambled(left, 3 - r), left
            else:
                left, right = right, left ^ scrambled(right, r)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def rest_slots(rest: int, size: int, block: int, key: int) -> tuple[int, int]:
    """(slots, words of the last one) that take `rest` < size words in the epoch's permuted order of blocks."""
    n = -(-size // block)
    if not rest:
        return 0, 0
    last = size - (n - 1) * block  # words of the source's last block, which may be short
    full = -(-rest // block)
    place = int(permuted(np.array([n - 1]), n, key, inverse=True)[0])
    if place < full - 1 or (place == full - 1 and rest - (full - 1) * block > last):  # the short block is among them
        after = rest - last
        return (1 + -(-after // block), after - (-(-after // block) - 1) * block) if after else (1, last)
    return full, rest - (full - 1) * block


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, _h: written out once, so texts are read once for it."""
    text = common.text_or_empty()
    return common.cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_h")))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """A row per source: source, k (its number from 0), source_size, target.

    Sources are numbered by ranges, and the water level is found in a few rounds of sums over them: sources whose cap is under it are full, and what they leave
    is shared by the others. So there may be as many sources as web domains."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    s = common.numbered(sums, "_null", "source").withColumnRenamed("_row", "k").drop("_null")
    s = common.cut(s.withColumns({"w": F.col("k") % 3 + 1, "cap": most * F.col("source_size")}))
    level, full = 0.0, -1
    while True:
        under = F.col("cap") <= F.col("w") * F.lit(level) if full >= 0 else F.lit(False)
        total, left, weight, n = s.agg(F.sum("source_size"), F.sum(F.when(~under, 0).otherwise(F.col("cap"))), F.sum(F.when(~under, F.col("w"))), F.count_if(under)).head()
        if not weight or n == full:
            break
        level, full = (total - left) / weight, n
    return s.select("source", F.col("k").cast("int").alias("k"), "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def halved(count: int, shards: int, key: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(shard, first slot, slots) of the shards in [start, stop) that get any of a source's `count` slots: binomial draws down a tree over all shards, seeded by node."""
    stop = shards if stop is None else stop
    todo = [(0, shards, 0, count)]
    while todo:
        a, z, at, n = todo.pop()
        if not n or z <= start or a >= stop:
            continue
        if z - a == 1:
            yield a, at, n
            continue
        m = (a + z) // 2
        left = int(np.random.default_rng([key & 0xFFFFFFFF, key >> 32, a, z]).binomial(n, (m - a) / (z - a)))
        todo += [(m, z, at + left, n - left), (a, m, at, left)]


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every slot of the mix: k (source), shard, slot, epoch, block, words (taken from the block's start)."""
    total = sources.agg(F.sum("target")).head()[0] or 0.0
    shards = max(1, int(-(-total // (block_words * slots_per_shard))))
    asked = sources.select("k", "source", "source_size", F.least(F.round("target").cast("long"), most * F.col("source_size")).alias("n")).filter("n > 0")
    # a row per source and portion of the shards, as many as its slots ask for
    portions = F.least(F.lit(shards), F.ceil(F.col("n") / (block_words * SLOTS_PER_ROW))).cast("long")
    width = F.ceil(F.lit(shards) / portions).cast("long")
    asked = asked.withColumn("width", width).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"), F.col("width"))))
    # by a stated number: the rows are few and small, but each makes many slots, so they mustn't be gathered in one task
    asked = asked.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "start")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, n = r["source_size"], -(-r["source_size"] // block_words)
                epochs = r["n"] // size
                rest, trim = rest_slots(r["n"] - epochs * size, size, block_words, _key(seed, r["source"], epochs))
                count = epochs * n + rest
                for shard, first, drawn in halved(count, shards, _key(seed, "shards", r["source"]), r["start"], r["start"] + r["width"]):
                    for a in range(first, first + drawn, 1 << 16):
                        slot = np.arange(a, min(first + drawn, a + (1 << 16)))
                        epoch, block = slot // n, np.zeros(len(slot), np.int64)
                        for e in np.unique(epoch):
                            block[epoch == e] = permuted(slot[epoch == e] % n, n, _key(seed, r["source"], int(e)))
                        taken = np.where(block == n - 1, size - (n - 1) * block_words, block_words)
                        if rest:
                            taken = np.where(slot == count - 1, np.minimum(taken, trim), taken)
                        m = len(slot)
                        yield pa.RecordBatch.from_pydict({"k": pa.array([r["k"]] * m, pa.int32()), "shard": pa.array([shard] * m, pa.int64()), "slot": pa.array(slot), "epoch": pa.array(epoch), "block": pa.array(block), "words": pa.array(taken)})

    return asked.mapInArrow(fill, "k int, shard long, slot long, epoch long, block long, words long")


def laid(sized: DataFrame, sources: DataFrame, buckets: int = 256) -> DataFrame:
    """Documents of size > 0 with k, source_size, target and _at: the number of their first word in their source."""
    known = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").filter("size > 0").withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(buckets)))
    sums = known.groupBy("k", "_b").agg(F.sum("size").alias("_n"))
    before = sums.select("k", "_b", (F.sum("_n").over(Window.partitionBy("k").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("k", "_b").orderBy("doc_id", "_h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return known.withColumn("_in", inside).join(before, ["k", "_b"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def _parts(at: DataFrame, block_words: int) -> DataFrame:
    """A row per document and block that it reaches into: _block, _a and _z (its words in the block, from the block's start)."""
    first, last = F.floor(F.col("_at") / block_words), F.floor((F.col("_at") + F.col("size") - 1) / block_words)
    out = at.select("*", F.explode(F.sequence(first, last)).alias("_block"))
    start = F.col("_block") * block_words
    return out.withColumns({"_a": F.greatest(F.lit(0), F.col("_at") - start), "_z": F.least(F.lit(block_words), F.col("_at") + F.col("size") - start)})


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), and first_shard and n_shards: the least output shard that holds any of it (else null), and
    how many shards its blocks' slots are in."""
    sized = _sized(docs)
    sources = common.cut(targets(sized, most))
    picked = slots(sources, block_words, slots_per_shard, most, seed).groupBy("k", "block", "words").agg(F.count("*").alias("times"), F.collect_set("shard").alias("shards")).hint("merge")  # its size is unknown to the planner
    parts = _parts(laid(sized, sources), block_words)
    words = F.greatest(F.lit(0), F.least("_z", "words") - F.col("_a"))
    row = ["doc_id", "k", "size", "source_size", "target", "_at"]
    met = parts.join(picked, (parts["k"] == picked["k"]) & (parts["_block"] == picked["block"]), "left").drop(picked["k"])
    inside = F.array_distinct(F.flatten(F.collect_list(F.when(words > 0, F.col("shards")))))  # at most `most` per block and epoch
    found = met.groupBy(*row).agg(F.sum(F.coalesce(words * F.col("times"), F.lit(0))).cast("long").alias("taken"), inside.alias("_s"))
    found = found.withColumns({"first_shard": F.array_min("_s"), "n_shards": F.size("_s").cast("long")})
    empty = sized.filter("size = 0").join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long"), "n_shards": F.lit(0).cast("long")})
    out = ["doc_id", "size", "source_size", "target", "taken", "first_shard", "n_shards"]
    return found.select(*out).unionByName(empty.select(*out))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, most: int = MOST, seed: int = SEED, with_shard: bool = False) -> DataFrame:
    """The mix as documents: a row per unbroken stretch of a document's words in one epoch and shard, with
    the document's other columns. The text keeps the white space between its words; a whole document keeps its text as it is. A column n_chars follows the text.
    Rows stand shard by shard, in a drawn order within it; with_shard adds a column `shard` (or the like, if there is one)."""
    sized = _sized(docs)
    sources = common.cut(targets(sized, most))
    picked = slots(sources, block_words, slots_per_shard, most, seed).hint("merge")
    copy = Window.partitionBy("doc_id", "_h", "source").orderBy("_at")
    at = laid(sized, sources).withColumn("_copy", F.row_number().over(copy))
    parts = _parts(at, block_words)
    pieces = (
        parts.join(picked, (parts["k"] == picked["k"]) & (parts["_block"] == picked["block"]))
        .withColumn("_from", F.col("_block") * block_words - F.col("_at") + F.col("_a"))
        .withColumn("_to", F.col("_from") + F.least("_z", "words") - F.col("_a"))
        .filter("_to > _from")
        .groupBy("doc_id", "_h", "source", "_copy")
        .agg(F.array_sort(F.collect_list(F.struct("epoch", "_from", "_to", "shard", "slot"))).alias("_pieces"))
    )
    h, c, p, shard, order = (common.fresh(docs, x) for x in ("_h", "_copy", "_pieces", "shard", "_order"))
    text = docs.withColumn(h, F.xxhash64(common.text_or_empty()))
    others = [x for x in docs.columns if x.lower() not in ("doc_id", "text", "source")]
    same = Window.partitionBy("doc_id", h, F.col("source").cast("string")).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    text = text.withColumn(c, F.row_number().over(same))
    d1, h1, s1, c1 = (common.fresh(docs, x) for x in ("_d1", "_h1", "_s1", "_c1"))
    right = pieces.select(F.col("doc_id").alias(d1), F.col("_h").alias(h1), F.col("source").alias(s1), F.col("_copy").alias(c1), F.col("_pieces").alias(p))
    both = text.join(right, F.col("doc_id").eqNullSafe(F.col(d1)) & (F.col(h) == F.col(h1)) & F.col("source").cast("string").eqNullSafe(F.col(s1)) & (F.col(c) == F.col(c1))).select(*docs.columns, p, h)
    names = docs.columns

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows, texts, places = [], [], []
            for i, (t, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column(p).to_pylist(), strict=True)):
                raw, spans = None, []
                for x in found:
                    if spans and spans[-1][:2] == [x["epoch"], x["shard"]] and spans[-1][3] == x["_from"]:
                        spans[-1][3] = x["_to"]
                    else:
                        spans.append([x["epoch"], x["shard"], x["_from"], x["_to"], x["slot"]])
                for _, s, a, b, slot in spans:
                    if raw is None:
                        raw = t.encode("utf-8", "surrogatepass")
                        word = np.frombuffer(raw.translate(common.SPACED), np.uint8) != 32
                        edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
                        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    rows.append(i)
                    places.append((s, slot))
                    texts.append(t if a == 0 and b == len(starts) else raw[starts[a] : stops[b - 1]].decode("utf-8", "surrogatepass"))
            out = batch.select(names).take(pa.array(rows, pa.int64()))
            columns = list(out.columns)
            at = {f.name.lower(): i for i, f in enumerate(out.schema)}
            columns[at["text"]] = pa.array(texts, out.schema.field(at["text"]).type)
            if "n_chars" in at and pa.types.is_integer(out.schema.field(at["n_chars"]).type):
                columns[at["n_chars"]] = pc.utf8_length(columns[at["text"]]).cast(out.schema.field(at["n_chars"]).type)
            n = np.array(places, np.int64).reshape(-1, 2)
            drawn = common.mix(batch.column(h).to_numpy()[np.array(rows, np.int64)].astype(np.uint64) + common.mix(n[:, 1].astype(np.uint64))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[:, 0]), pa.array(drawn)], names=[*names, shard, order])

    added = [T.StructField(shard, T.LongType()), T.StructField(order, T.LongType())]
    dealt = both.mapInArrow(cut_out, T.StructType([*docs.schema.fields, *added]))
    return dealt.repartition(shard).sortWithinPartitions(shard, order).select(*names, *[shard] * with_shard)

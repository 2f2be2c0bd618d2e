"""Suffix order of symbol tables by the difference-cover algorithm modulo 3, in DataFrame operations.

Sort the triples at positions that aren't multiples of 3, name them, recurse on the names while they repeat, order the
remaining suffixes by (symbol, rank of the next), and merge: two suffixes differ in their first symbols, or else in the ranks of the
sampled suffixes one or two places on. Every step is a range sort, a join on positions or a prefix sum over partitions.

Texts are laid one after the other, each closed by a separator that is less than any symbol and different from every
other, so no common prefix passes an end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _named(df: DataFrame, *key: str) -> DataFrame:
    """df with name: the rank from 1 of its key among the distinct keys."""
    names = common.numbered(df.select(*key).distinct(), *key).withColumn("name", F.col("_row") + 1).drop("_row")
    return df.join(names, list(key))


def _shifted(text: DataFrame, by: int, name: str) -> DataFrame:
    return text.select((F.col("pos") - by).alias("pos"), F.col("sym").alias(name))


def suffix_ranks(text: DataFrame) -> DataFrame:
    """text(pos from 0, sym long >= 1) -> pos, rank from 1 of the suffix that starts there. What lies beyond the end counts as 0."""
    n = text.count()
    if n <= 1:
        return text.select("pos", F.lit(1).cast("long").alias("rank"))
    triples = text.select("pos", F.col("sym").alias("s0")).join(_shifted(text, 1, "s1"), "pos", "left").join(_shifted(text, 2, "s2"), "pos", "left").fillna(0)
    triples = common.cut(triples)
    named = common.cut(_named(triples.filter("pos % 3 <> 0"), "s0", "s1", "s2").select("pos", "name"))
    m = named.count()
    if named.agg(F.max("name")).head()[0] < m:
        # positions 1, 4, 7, .. then 2, 5, 8, ..: a triple's successor stands next to it. A symbol of its own parts the halves
        half = (n + 1) // 3
        at = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(half + 1 + F.floor(F.col("pos") / 3)).cast("long")
        sampled = named.select(at.alias("at"), "pos", (F.col("name") + 1).alias("sym"))
        parting = text.sparkSession.range(1).select(F.lit(half).cast("long").alias("pos"), F.lit(1).cast("long").alias("sym"))
        below = suffix_ranks(sampled.select(F.col("at").alias("pos"), "sym").unionByName(parting))
        ranks = common.numbered(sampled.join(below.select(F.col("pos").alias("at"), "rank"), "at").select("pos", "rank"), "rank").select("pos", (F.col("_row") + 1).alias("rank"))
    else:
        ranks = named.select("pos", F.col("name").alias("rank"))
    ranks = common.cut(ranks)
    near = lambda by: ranks.select((F.col("pos") - by).alias("pos"), F.col("rank").alias(f"r{by}"))
    full = triples.join(near(0), "pos", "left").join(near(1), "pos", "left").join(near(2), "pos", "left").fillna(0)
    # remaining suffixes by (symbol, next rank); then both lists merge: each row's place is its place in its own list and how many of the other are less
    sample = common.cut(full.filter("pos % 3 <> 0"))
    other = common.cut(common.numbered(full.filter("pos % 3 = 0"), "s0", "r1").withColumnRenamed("_row", "own"))
    return _merged(sample, other)


def _merged(sample: DataFrame, other: DataFrame) -> DataFrame:
    """Against suffixes at 1 mod 3, (s0, r1) decides; against those at 2 mod 3, (s0, s1, r2)."""
    one, two = sample.filter("pos % 3 = 1"), sample.filter("pos % 3 = 2")

    def less(rows: DataFrame, than: DataFrame, key: list[str]) -> DataFrame:
        """pos, less: for each row of `rows` how many of `than` come before it; no two keys are equal."""
        both = than.select("pos", *key, F.lit(1).alias("t")).unionByName(rows.select("pos", *key, F.lit(0).alias("t")))
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = common.cut(both.repartitionByRange(n, *key, "pos").select("*", F.spark_partition_id().alias("_part")))
        sizes = placed.groupBy("_part").agg(F.sum("t").alias("_t"))
        before = sizes.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_before"))
        running = F.sum("t").over(Window.partitionBy("_part").orderBy(*key, "pos").rowsBetween(Window.unboundedPreceding, 0))
        return placed.withColumn("_run", running).join(before, "_part").filter("t = 0").select("pos", (F.col("_run") + F.col("_before")).cast("long").alias("less"))

    a, b = ["s0", "r1"], ["s0", "s1", "r2"]
    of_other = other.join(less(other, one, a).withColumnRenamed("less", "l1"), "pos").join(less(other, two, b).withColumnRenamed("less", "l2"), "pos").select("pos", (F.col("own") + F.col("l1") + F.col("l2") + 1).alias("rank"))
    of_sample = sample.select("pos", "r0").join(less(one, other, a).unionByName(less(two, other, b)), "pos").select("pos", (F.col("r0") + F.col("less")).alias("rank"))
    return common.cut(of_other.unionByName(of_sample))


def symbols(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as one text: pos, sym, doc_id, byte. Separators, one per document, are less than bytes and differ from each other; documents are laid out by doc_id and hash."""
    sized = docs.select("doc_id", common.text_or_empty().cast("binary").alias("raw")).withColumn("_h", F.xxhash64("raw"))
    order = common.numbered(sized.select("doc_id", "_h", (F.octet_length("raw") + 1).alias("size"), "raw"), "doc_id", "_h")
    count = order.count()
    placed = common.cut(order.withColumnRenamed("_row", "nth"))
    blocks = placed.select((F.col("nth") / 4096).cast("long").alias("_blk"), "nth", "size")
    sums = blocks.groupBy("_blk").agg(F.sum("size").alias("_s"))
    starts = sums.select("_blk", (F.sum("_s").over(Window.orderBy("_blk")) - F.col("_s")).alias("_b"))
    own = blocks.join(starts, "_blk").select("nth", (F.col("_b") + F.sum("size").over(Window.partitionBy("_blk").orderBy("nth")) - F.col("size")).alias("start"))
    digits = F.transform(F.sequence(F.lit(1), F.octet_length("raw")), lambda i: F.conv(F.hex(F.substring("raw", i, F.lit(1))), 16, 10).cast("long") + count + 1)
    row = placed.join(own, "nth")
    every = row.select("doc_id", "_h", "nth", "start", F.posexplode(F.concat(F.when(F.octet_length("raw") > 0, digits).otherwise(F.array().cast("array<bigint>")), F.array((F.col("nth") + 1).cast("long")))).alias("byte", "sym"))
    return every.select("doc_id", "_h", "nth", (F.col("start") + F.col("byte")).cast("long").alias("pos"), "byte", "sym")


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, nth, byte: where strings of `length` bytes start that start elsewhere too, by adjacent suffixes that share a prefix of that length.

    Prefixes are compared by doubling: a prefix of 2k symbols has the name of (name of k here, name of k further on)."""
    text = common.cut(symbols(docs))
    ranks = suffix_ranks(text.select("pos", "sym"))
    names, k = text.select("pos", F.col("sym").alias("name")), 1
    while k < length:
        step = min(k, length - k)
        pairs = names.join(names.select((F.col("pos") - step).alias("pos"), F.col("name").alias("next")), "pos")
        names, k = common.cut(_renamed(pairs)), k + step
    ordered = common.numbered(names.join(ranks, "pos"), "rank").select("pos", "name", "_row")
    beside = ordered.select((F.col("_row") + 1).alias("_row"), F.col("name").alias("before"))
    after = ordered.select((F.col("_row") - 1).alias("_row"), F.col("name").alias("after"))
    hit = ordered.join(beside, "_row", "left").join(after, "_row", "left").filter("name = before or name = after").select("pos")
    return text.join(hit, "pos").select("doc_id", "nth", "byte")


def _renamed(pairs: DataFrame) -> DataFrame:
    return _named(pairs.withColumnsRenamed({"name": "first"}), "first", "next").select("pos", "name")

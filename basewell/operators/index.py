"""The multimap from cores to occurrences: counts, cap, values, layout and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.params import IndexParams
from . import ranges as sorted_ranges
from . import running

#: Keys of at most so many bases are few enough (2.1 million) to be broadcast with their counts, so occurrences needn't move to meet them.
FEW = 11


def counts(occurrences: DataFrame) -> DataFrame:
    """key, n of every key, before any cap."""
    return occurrences.groupBy("key").agg(F.count("*").alias("n"))


def kept_keys(all_counts: DataFrame, p: IndexParams) -> DataFrame:
    return all_counts if p.cap is None else all_counts.filter(F.col("n") <= p.cap)


def skipped_keys(all_counts: DataFrame, p: IndexParams) -> DataFrame:
    return all_counts.filter(F.lit(False) if p.cap is None else F.col("n") > p.cap)


def long_index(occurrences: DataFrame, p: IndexParams, every: DataFrame | None = None) -> DataFrame:
    """key, n, ref_id, pos, flank (null where the key has no flanks). Occurrences of dropped keys are absent. `every` has the counts of all keys, if they are known.

    Counts are aggregated first and broadcast, so occurrences aren't shuffled at all, or, where keys have more than FEW bases, joined back. Then keys over the cap, the most frequent ones, go before
    their occurrences are shuffled; without a cap Spark splits the join's skewed partitions."""
    every = counts(occurrences) if every is None else every
    keys = kept_keys(every, p)
    if p.c <= FEW:
        keys = F.broadcast(keys)
    elif p.cap is not None:
        occurrences = occurrences.join(skipped_keys(every, p).select("key"), "key", "left_anti")
    both = occurrences.join(keys, "key").select("key", "n", "ref_id", "pos", F.when(F.col("n") > p.header_threshold, F.col("flank")).alias("flank"))
    return truncated(both, p, every) if p.layout == "hash" else both


def slots(index: DataFrame, p: IndexParams | None = None, every: DataFrame | None = None, flanks: bool = True) -> DataFrame:
    """index with slot: an occurrence's place in its range, from 0 in (ref_id, pos) order. Without `flanks` they aren't moved, and absent.

    Without a cap in p, a key may hold any share of all rows, in one reference or in many: its occurrences are numbered over sorted ranges, whose bounds come from the counts of all keys (`every`, if they are known)."""
    kept = [c for c in index.columns if flanks or c != "flank"]
    if p is not None and p.cap is not None:
        return index.select(kept).withColumn("slot", F.row_number().over(Window.partitionBy("key").orderBy("ref_id", "pos")).cast("long") - 1)
    more = [c for c in kept if c not in ("key", "ref_id", "pos")]
    if any(index.schema[c].dataType.typeName() not in ("long", "integer", "short", "byte") for c in ("key", "ref_id", "pos", *more)):
        return running.ranked(index.select(kept), "key", ["ref_id", "pos"], "slot")
    return sorted_ranges.ordered(index, counts(index) if every is None else every, *more).select(*kept, "slot")


def truncated(index: DataFrame, p: IndexParams, every: DataFrame | None = None) -> DataFrame:
    """What a hash layout keeps: its ranges have no room for flanks, so they cover the last ceil(n / 3) values of larger ranges."""
    room = F.when(F.col("n") > p.header_threshold, F.col("n") - F.ceil(F.col("n") / 3)).otherwise(F.col("n"))
    return slots(index, p, every).filter(F.col("slot") < room).drop("slot")


def nested(index: DataFrame) -> DataFrame:
    """key, n, values: array of (ref_id, pos, flank) in (ref_id, pos) order. For capped indexes: a key's values share a row."""
    return index.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("ref_id", "pos", "flank"))).alias("values"))


#: Occurrences of a page.
PAGE = 1024


def pages(index: DataFrame, size: int = PAGE, every: DataFrame | None = None) -> DataFrame:
    """A key's range in pages of at most `size` values, in (ref_id, pos) order: key, page (from 0), n, first_ref, and arrays refs (less first_ref), positions and flanks.

    A key of any number of values is a row per page; no task or row holds a range."""
    parts = {"refs": "ref_id", "positions": "pos", "flanks": "flank"}
    columns = lambda r, a, z: {name: r.array(c, a, z) for name, c in parts.items()}
    rows, first = sorted_ranges.paged(index, counts(index) if every is None else every, size, columns, dict.fromkeys(parts, "long"), more=("flank", "n")), F.col("refs")[0]
    return rows.select("key", "page", "n", first.alias("first_ref"), F.transform("refs", lambda x: (x - first).cast("int")).alias("refs"), "positions", "flanks")


def unpaged(paged: DataFrame) -> DataFrame:
    """The long index that pages were made of: key, n, ref_id, pos, flank. Lookups take it as any index."""
    values = paged.select("key", "n", "first_ref", F.explode(F.arrays_zip("refs", "positions", "flanks")).alias("v"))
    return values.select("key", "n", (F.col("first_ref") + F.col("v.refs")).alias("ref_id"), F.col("v.positions").alias("pos"), F.col("v.flanks").alias("flank"))


def ranges(keys: DataFrame, p: IndexParams) -> DataFrame:
    """Layout of keys(key, n) in one array of cells, in key order: v_start, v_end, header_cells, has_flank, and the key's block and cell. Starts are prefix sums over sorted ranges of keys, of any width."""
    cells = F.col("n") if p.layout == "hash" else dna.range_cells("n", p.header_threshold)  # a hash layout has no room for flanks
    placed = running.sums(keys.select("key", "n", cells.cast("long").alias("v_size")), ["key"], "v_size")
    blk, width = F.shiftright("key", p.block_shift), p.cells_per_body + 4
    return placed.select(
        "key",
        "n",
        F.col("v_size_before").alias("v_start"),
        (F.col("v_size_before") + F.col("v_size")).alias("v_end"),
        (F.col("n") > p.header_threshold).alias("has_flank"),
        dna.header_cells("v_size", p.header_threshold).alias("header_cells"),
        (blk * width).cast("long").alias("block_cell"),
        (blk * width + 4 + F.pmod("key", F.lit(p.cells_per_body))).cast("long").alias("key_cell"),
    )


def stats(sampling: DataFrame, all_counts: DataFrame, p: IndexParams) -> DataFrame:
    """One row: kmers, sampled, refs (of `sampling`), rate (null without k-mers), distinct_keys (before the cap), skipped_keys, value_cells (after it)."""
    over = F.lit(False) if p.cap is None else F.col("n") > p.cap
    keys = all_counts.agg(F.count("*").alias("distinct_keys"), F.count_if(over).alias("skipped_keys"), F.coalesce(F.sum(F.when(~over, dna.range_cells("n", p.header_threshold))), F.lit(0)).cast("long").alias("value_cells"))
    rate = F.try_divide(F.col("sampled").cast("double"), F.col("kmers"))
    return sampling.join(keys).select("kmers", "sampled", rate.alias("rate"), "distinct_keys", "skipped_keys", "value_cells", "refs")  # two single rows

"""Bulk lookups in an index: queries(query_id, qpos, key, flank) against index(key, n, ref_id, pos, flank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.params import IndexParams
from ..sources import store
from . import running, sketch, windows


def queries_of(sequences: DataFrame, p: IndexParams) -> DataFrame:
    """Every sampled window of some sequences, as queries."""
    return windows.occurrences(sequences, p).select(F.col("ref_id").alias("query_id"), F.col("pos").alias("qpos"), "key", "flank")


def lookup(index: DataFrame, key: int) -> DataFrame:
    """The rows of one key. Of a saved index one folder is read."""
    if _parted(index):
        index = index.parted.filter(F.col("part") == key >> index.part_shift).drop("part")
    return index.filter(F.col("key") == key)


def canonical_number(word: str) -> int:
    """The key of a core given as text: the number of the lesser of it and its reverse complement."""
    other = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return int(min(word, other).translate(str.maketrans("ACGT", "0123")), 4)


def lookup_word(index: DataFrame, word: str) -> DataFrame:
    """The rows of a core given as text, which is made canonical here."""
    return lookup(index, canonical_number(word))


def _parted(index: DataFrame) -> bool:
    """Whether an index was loaded from disk, where it lies in folders by key range."""
    return hasattr(index, "parted")


def _met(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Queries and the occurrences of their keys. Of a saved index only the folders of asked key ranges are read."""
    asked = queries.withColumnRenamed("flank", "qflank")
    if not _parted(index):
        return asked.join(index.select("key", "n", "ref_id", F.col("pos").alias("rpos"), "flank"), "key")
    return asked.withColumn("part", store.part_of("key", index.part_shift)).join(index.parted.select("part", "key", "n", "ref_id", F.col("pos").alias("rpos"), "flank"), ["part", "key"])


def all_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, qpos, key, ref_id, rpos: every position of every query's key."""
    return _met(queries, index).select("query_id", "qpos", "key", "ref_id", "rpos")


def best_flex_match(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, qpos, key, ref_id, rpos, dist, ties: the positions whose flanks are nearest, all of them if several are; where the key
    has no flanks every position, with null dist and ties. A query is (query_id, qpos), and has one row in `queries`.

    The least distance and its ties are found between a key's different flanks and the different flanks that ask for it, by aggregates that are merged before they are shuffled, so
    a query that meets a third of the index is no single task; then only the positions of the nearest flanks are joined."""
    asked = queries.withColumnRenamed("flank", "qflank")
    by_key, by_flank = ["key", "part"] if _parted(index) else ["key"], ["key", "flank"]
    if _parted(index):
        asked = asked.withColumn("part", store.part_of("key", index.part_shift))
    held = (index.parted if _parted(index) else index).withColumnRenamed("pos", "rpos")
    if _parted(index):  # flanks of other keys needn't be counted; the filter is of bounded size, so the index isn't moved to meet the asked keys
        held = sketch.pruned(held, store.written(sketch.bloom(asked.select("key").distinct())))
    plain = asked.join(held.filter("flank is null").select(*by_key, "ref_id", "rpos"), by_key).select("query_id", "qpos", "key", "ref_id", "rpos", F.lit(None).cast("int").alias("dist"), F.lit(None).cast("long").alias("ties"))
    flanks = held.filter("flank is not null").groupBy(*by_key, "flank").agg(F.count("*").alias("m"))
    pairs = asked.select(*by_key, "qflank").distinct().join(flanks, by_key).select("key", "qflank", "flank", "m", dna.hamming("qflank", "flank").alias("dist"))
    least = pairs.groupBy("key", "qflank", "dist").agg(F.sum("m").alias("ties")).groupBy("key", "qflank").agg(F.min(F.struct("dist", "ties")).alias("b"))
    least = least.select("key", "qflank", "b.dist", "b.ties")
    nearest = asked.drop("part").join(pairs.join(least, ["key", "qflank", "dist"]), ["key", "qflank"])
    if _parted(index):
        nearest, by_flank = nearest.withColumn("part", store.part_of("key", index.part_shift)), [*by_flank, "part"]
    found = nearest.join(held.select(*by_flank, "ref_id", "rpos"), by_flank)
    return plain.unionByName(found.select("query_id", "qpos", "key", "ref_id", "rpos", "dist", "ties"))


def misses(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The queries whose key is absent (or was dropped)."""
    return queries.join(index.select("key").distinct(), "key", "left_anti")


def rarest_first(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, qpos, key, n, rank: each query sequence's seeds by how few positions they have, from rank 1; ties by key, then qpos."""
    found = queries.join(keys.select("key", "n"), "key")
    return running.ranked(found.select("query_id", "qpos", "key", "n"), "query_id", ["n", "key", "qpos"], "rank").withColumn("rank", F.col("rank") + 1)


def with_names(matches: DataFrame, refs: DataFrame) -> DataFrame:
    return matches.join(refs, "ref_id")


def with_ids(names: DataFrame, refs: DataFrame) -> DataFrame:
    """names(name, ...) with ref_id; a name that isn't in the dictionary has none."""
    return names.join(refs, "name", "left")


def nearest_in(values, flank) -> F.Column:
    """The nearest of a nested range's values, without a window: array of (ref_id, pos, dist), dist null without flanks."""
    scored = F.transform(values, lambda v: F.struct(v["ref_id"].alias("ref_id"), v["pos"].alias("pos"), F.when(v["flank"].isNotNull(), dna.hamming(v["flank"], flank)).alias("dist")))
    return F.filter(scored, lambda v: v["dist"].eqNullSafe(F.array_min(F.transform(scored, lambda x: x["dist"]))))

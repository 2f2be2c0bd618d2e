"""Indexes on disk: Parquet tables keys, index and refs beside meta, all in one folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import IndexParams
from ..operators import ranges

#: 3: tables in folders by key range. 1 had none, 2 was never written.
FORMAT_VERSION = 3


#: Folders of key ranges of a saved index.
PART_BITS = 6


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset; then it is a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_cut').rstrip('/')}/basewell-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_shift(p: IndexParams) -> int:
    """How many low bits of a key stand below those that name its folder."""
    return max(0, 2 * p.c - PART_BITS)


def part_of(key, shift: int) -> F.Column:
    """The folder of a key of a saved index: a range of keys."""
    return F.shiftright(key, shift).cast("int")


def save(path: str, index: DataFrame, keys: DataFrame, refs: DataFrame, p: IndexParams, mode: str = "errorifexists") -> None:
    """Writes the tables, then meta, whose presence marks a whole index. Index and keys lie in folders by key range, so a lookup reads the asked ones only, and are sorted by key in them, so a key's
    filter skips most row groups. Occurrences are packed and shuffled once, to ranges whose bounds come from the keys."""
    n, part = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), part_of("key", part_shift(p))
    more = ("flank", "n") if p.layout == "hash" else ("flank",)  # a hash layout holds fewer occurrences than n
    dealt = ranges.ordered(index, keys, *more).select("key", "n", "ref_id", "pos", "flank")
    for name, table, order in (("index", dealt, ["key", "ref_id", "pos"]), ("keys", keys.repartitionByRange(n, "key"), ["key"])):
        table.withColumn("part", part).sortWithinPartitions("part", *order).write.mode(mode).option("compression", "zstd").partitionBy("part").parquet(f"{path}/{name}")
    refs.write.mode(mode).parquet(f"{path}/refs")
    meta = index.sparkSession.createDataFrame([(FORMAT_VERSION, json.dumps(p.as_dict()))], "format_version int, params string")
    meta.coalesce(1).write.mode(mode).json(f"{path}/meta")


def save_bucketed(index: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """The index as a bucketed table: lookups that are bucketed alike join without moving it."""
    index.write.mode(mode).bucketBy(buckets, "key").sortBy("key", "ref_id", "pos").saveAsTable(table)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, IndexParams]:
    """(index, keys, refs, params); another format version raises. Lookups in the index (see match) read the folders of the asked keys only: where Spark can broadcast the asked
    keys' folders it prunes them as the query runs."""
    row = spark.read.schema("format_version int, params string").json(f"{path}/meta").head()
    if row is None or row["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path}: format version {row and row['format_version']}, not {FORMAT_VERSION}")
    p = IndexParams(**json.loads(row["params"]))
    parted = spark.read.schema("key long, n long, ref_id long, pos long, flank long, part int").parquet(f"{path}/index")
    index = parted.drop("part")
    index.parted, index.part_shift = parted, part_shift(p)  # for the lookups of match
    return index, spark.read.schema("key long, n long, part int").parquet(f"{path}/keys").drop("part"), spark.read.parquet(f"{path}/refs"), p


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt to all cores, if it has fewer splits than that: windows are many times larger than their sequences. Tables of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def derived_dna(text) -> F.Column:
    """DNA from any text, for tables without sequences: its letters a to z, dealt to A C G T in turn."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")

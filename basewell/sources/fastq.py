"""FASTQ files of any size: reads(ref_id, name, seq, qual), and columns over their qualities.

A record is four lines: @name, bases, +, one quality character for each base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running
from . import fasta, store

#: Quality characters start here: fixed value of the format.
LOWEST = 33


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of file blocks: whole records (line: number of the first one in the block; head, seq, plus, qual), and single lines (head alone) where a batch or block begins or ends inside a record.

    Records start where a line begins with @ and the one after next with +: no line of bases begins with either, so a quality line can't be taken for a name."""
    of, line = None, 0
    kinds = [("f", pa.int64()), ("block", pa.int64()), ("file", pa.string()), ("line", pa.int64()), ("whole", pa.bool_()), ("head", pa.string()), ("seq", pa.string()), ("plus", pa.string()), ("qual", pa.string())]
    for batch in batches:
        f, block, values = batch.column("f").to_numpy(), batch.column("block").to_numpy(), batch.column("value")
        edges = np.unique([0, *(np.flatnonzero((np.diff(f) != 0) | (np.diff(block) != 0)) + 1), len(values)])
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if of != (int(f[a]), int(block[a])):
                of, line = (int(f[a]), int(block[a])), 0
            own = values.slice(a, z - a)
            at = pc.starts_with(own.slice(0, 4), "@").to_numpy(zero_copy_only=False)
            plus = pc.starts_with(own.slice(0, 6), "+").to_numpy(zero_copy_only=False)
            start = next((i for i in range(min(4, len(own) - 2)) if at[i] and plus[i + 2]), None)
            n = 0 if start is None else (len(own) - start) // 4
            first = start or 0
            loose = [i for i in range(len(own)) if not n or i < first or i >= first + 4 * n]
            order = np.concatenate([np.arange(first, first + 4 * n, 4), loose]).astype(np.int64)
            whole = np.arange(len(order)) < n
            column = lambda k: own.take(pa.array(np.where(whole, order + k, 0), mask=~whole))  # noqa: B023, E731
            cells = [pa.array(np.full(len(order), of[0])), pa.array(np.full(len(order), of[1])), batch.column("file").slice(a, 1).take(pa.array(np.zeros(len(order), np.int64))), pa.array(line + order), pa.array(whole), own.take(pa.array(order)), column(1), column(2), column(3)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(cells, kinds, strict=True)], names=[k for k, _ in kinds])
            line += len(own)


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int | None = None) -> DataFrame:
    """reads(ref_id, name, seq, qual), numbered from 1 in the order of files' names and of records, from any store that Spark reads.

    Byte ranges are parsed once; records that a range's end cuts are put together by their line numbers, which are prefix sums over the ranges. A record that isn't one raises (FAILFAST) or goes (DROPMALFORMED), and the others keep their
    numbers."""
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    file = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.xxhash64(file).alias("f"), F.col("_metadata.file_block_start").alias("block"), file.alias("file"), "value")
    try:
        if split_bytes:
            spark.conf.set(key, str(split_bytes))
        raw = store.written(lines.mapInArrow(_cut, "f long, block long, file string, line long, whole boolean, head string, seq string, plus string, qual string"))
    finally:
        spark.conf.set(key, was)
    blocks = raw.groupBy("f", "block").agg(F.sum(F.when(F.col("whole"), 4).otherwise(1)).alias("lines"), F.max("file").alias("file"))
    placed = running.sums(blocks, ["file", "block"], "lines")
    firsts = placed.groupBy("f").agg(F.min("lines_before").alias("at")).withColumnRenamed("f", "_of")
    where = placed.join(firsts, F.col("f") == F.col("_of")).select(F.col("f").alias("_f"), F.col("block").alias("_b"), (F.col("lines_before") - F.col("at")).alias("before"))
    every = raw.join(where, (F.col("f") == F.col("_f")) & (F.col("block") == F.col("_b"))).withColumn("no", F.col("before") + F.col("line")).drop("_f", "_b")
    last = every.filter((F.col("no") % 4 == 0) & (F.col("head") != "")).groupBy("f", "file").agg((F.max(F.floor(F.col("no") / 4)) + 1).cast("long").alias("records"))
    numbered = running.sums(last, ["file"], "records").select(F.col("f").alias("_f"), "records_before")
    every = every.join(numbered, F.col("f") == F.col("_f"))
    record, phase = (F.col("records_before") + F.floor(F.col("no") / 4) + 1).cast("long"), F.col("no") % 4
    whole = every.filter(F.col("whole")).select(record.alias("ref_id"), "head", "seq", "plus", "qual")
    part = every.filter(~F.col("whole")).select(record.alias("ref_id"), phase.alias("k"), "head").groupBy("ref_id").agg(*[F.max(F.when(F.col("k") == k, F.col("head"))).alias(name) for k, name in enumerate(("head", "seq", "plus", "qual"))])
    empty = F.concat(*[F.coalesce(c, F.lit("")) for c in ("head", "seq", "plus", "qual")]) == ""
    found = whole.unionByName(part.filter(~empty))  # empty lines at a file's end are no record
    ok = F.coalesce(F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual")) & (F.translate(F.upper("seq"), fasta.IUPAC, "") == ""), F.lit(False))
    name = fasta.parse_name("head")
    if mode == "DROPMALFORMED":
        return found.filter(ok).select("ref_id", name.alias("name"), F.upper("seq").alias("seq"), "qual")
    seq = F.when(ok, F.upper("seq")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("head", F.lit("no name")))))
    return found.select("ref_id", name.alias("name"), seq.alias("seq"), "qual")


def trimmed(reads: DataFrame, least: int) -> DataFrame:
    """reads whose last bases of a quality under `least` are cut off."""
    low = "".join(f"\\x{c:02x}" for c in range(LOWEST, LOWEST + least))
    kept = F.regexp_replace("qual", f"[{low}]+$", "") if least > 0 else F.col("qual")
    return reads.withColumn("qual", kept).withColumn("seq", F.expr("substring(seq, 1, length(qual))"))


def errors(qual) -> F.Column:
    """Expected number of wrong bases: the sum of 10 ** (-q / 10)."""
    digits = F.split(F.col(qual) if isinstance(qual, str) else qual, "")
    return F.aggregate(digits, F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow(F.lit(10.0), (F.lit(LOWEST) - F.ascii(c)) / 10)))

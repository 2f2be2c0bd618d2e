"""From sequences to an index, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.params import IndexParams
from ..operators import index as ix
from ..operators import windows
from ..sources import fasta, store


@dataclass
class Index:
    index: DataFrame
    keys: DataFrame
    refs: DataFrame
    stats: DataFrame
    params: IndexParams

    def save(self, path: str, mode: str = "errorifexists") -> None:
        store.save(path, self.index, self.keys, self.refs, self.params, mode)


def build_index(sequences: DataFrame, p: IndexParams, names: DataFrame | None = None) -> Index:
    """sequences(ref_id, name, seq), or chunks(ref_id, start, seq) with names(ref_id, name).

    The bases are scanned first for counts of keys, k-mers and sequences, which are written in the shared folder, then whenever the index is read; occurrences, which take more than the bases, are not
    written for it. The dictionary reads names alone."""
    read = Observation()
    every = store.written(windows.counted(sequences.observe(read, F.count(F.lit(1)).alias("refs")), p))
    refs = fasta.checked_names(sequences.select("ref_id", "name") if names is None else names)
    counted = read.get["refs"] if names is None else names.count()
    all_counts, every_window = every.filter(F.col("key") != windows.EVERY), F.col("key") == windows.EVERY
    row = every.agg(*[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(c) for c, x in (("kmers", every_window), ("sampled", ~every_window))], F.lit(counted).cast("long").alias("refs"))
    return Index(ix.long_index(windows.occurrences(sequences, p), p, all_counts), ix.kept_keys(all_counts, p), refs, ix.stats(row, all_counts, p), p)


def build_files(spark: SparkSession, path: str, p: IndexParams, mode: str = "FAILFAST", split_bytes: int | None = None) -> Index:
    """The index of FASTA files of any size, whose long records are never in one row: pieces of byte ranges, then chunks that share k - 1 bases."""
    parts = fasta.checked_pieces(fasta.pieces(spark, path, split_bytes), mode)
    return build_index(fasta.chunks(parts, p.k), p, fasta.names(parts))

"""Windows, cores and occurrences of sequences. Their bases are numbered in Arrow batches (see words)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import IndexParams
from ..sources import store
from . import words

#: The most bases of a window that is numbered, windows that are counted together, and rows of a batch that goes back to Spark.
MOST_K, COUNTED, ROWS = 32, 1 << 21, 1 << 16
#: Bases of a sequence whose keys are not made distinct in memory.
LONG = 1 << 21
#: The key under which all windows are counted, sampled or not.
EVERY = -1


def _found(sequences: DataFrame, k: int, columns: Callable[[words.Block], Iterator[pa.RecordBatch]], schema: str, size: int = words.BLOCK) -> DataFrame:
    """A batch of columns for each block of the windows of sequences(ref_id, seq), or of their chunks with `start`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, k, size):
                made = columns(block)
                for i in range(0, made.num_rows, ROWS):
                    yield made.slice(i, ROWS)

    return _given(sequences).mapInArrow(run, schema)


def _given(sequences: DataFrame) -> DataFrame:
    start = F.col("start") if "start" in sequences.columns else F.lit(0)
    return sequences.select("ref_id", start.cast("long").alias("start"), "seq")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _kind(sequences: DataFrame) -> str:
    return dict(sequences.dtypes)["ref_id"]


def kmers(sequences: DataFrame, k: int) -> DataFrame:
    """ref_id, pos, kmer: every window of k bases over A C G T, from position 0 on the forward strand."""

    def columns(block: words.Block) -> pa.RecordBatch:
        at = np.flatnonzero(block.ok)
        ref, pos = block.placed(at)
        return _batch(ref_id=ref, pos=pos, kmer=block.text(at))

    return _found(sequences, k, columns, f"ref_id {_kind(sequences)}, pos long, kmer string", max(1, min(words.BLOCK, words.TEXT // k)))


def encoded(sequences: DataFrame, k: int) -> DataFrame:
    """ref_id, pos, kmer, key, decoded: every window, its number, and the word that is read back from the number. k is at most 31."""
    _check(k)

    def columns(block: words.Block) -> pa.RecordBatch:
        at = np.flatnonzero(block.ok)
        ref, pos = block.placed(at)
        key = words.ahead(block.codes, k)[at].astype(np.int64)
        return _batch(ref_id=ref, pos=pos, kmer=block.text(at), key=key, decoded=words.strings(words.decoded(key, k)))

    return _found(sequences, k, columns, f"ref_id {_kind(sequences)}, pos long, kmer string, key long, decoded string")


def turned(sequences: DataFrame, k: int) -> DataFrame:
    """ref_id, pos, kmer, rc: every window and its reverse complement."""

    def columns(block: words.Block) -> pa.RecordBatch:
        at = np.flatnonzero(block.ok)
        ref, pos = block.placed(at)
        return _batch(ref_id=ref, pos=pos, kmer=block.text(at), rc=block.text(at, True))

    return _found(sequences, k, columns, f"ref_id {_kind(sequences)}, pos long, kmer string, rc string", max(1, min(words.BLOCK, words.TEXT // k)))


def spectrum(sequences: DataFrame, k: int) -> DataFrame:
    """ref_id, key: every window's lesser strand, numbered. k is at most 31."""
    _check(k)

    def columns(block: words.Block) -> pa.RecordBatch:
        return _batch(ref_id=block.placed(np.flatnonzero(block.ok))[0], key=words.least(block))

    return _found(sequences, k, columns, f"ref_id {_kind(sequences)}, key long")


def spectrum_counts(sequences: DataFrame, k: int) -> DataFrame:
    """key, n, n_refs: how often a lesser strand occurs, and in how many references (null is none).

    A sequence's keys are made distinct where it is read, and counts are summed there over many sequences before they are shuffled. Only references of several rows, and sequences of over LONG bases, take
    a row per reference and key."""
    _check(k)
    whole = sequences.select("ref_id", "seq")
    several = store.written(whole.groupBy("ref_id").count().filter("count > 1 and ref_id is not null").select("ref_id"))
    apart, plain = F.length("seq") > LONG, whole
    if not several.isEmpty():
        plain = whole.join(several, "ref_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.whole_rows(batch, COUNTED):
                for block in words.blocks(part, k, part.nbytes + 1):
                    made = _batch(**dict(zip(("key", "n", "n_refs"), words.counts_and_rows(block), strict=True)))
                    yield from (made.slice(i, ROWS) for i in range(0, made.num_rows, ROWS))

    found = _given(plain.filter(~apart)).mapInArrow(run, "key long, n long, n_refs long")
    rest = [plain.filter(apart)] if several.isEmpty() else [plain.filter(apart), whole.join(several, "ref_id", "left_semi")]
    for rows in rest:
        each = spectrum(rows, k).groupBy("key", "ref_id").agg(F.count("*").alias("m"))
        found = found.unionByName(each.groupBy("key").agg(F.sum("m").alias("n"), F.count("ref_id").alias("n_refs")))
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_refs").alias("n_refs"))


def _check(k: int) -> None:
    if k >= MOST_K:
        raise ValueError(f"k is {k}; a key has at most {MOST_K - 1} bases")


def _fits(p: IndexParams) -> None:
    if p.k > MOST_K:
        raise ValueError(f"k is {p.k}; at most {MOST_K} bases fit a word")


def occurrences(sequences: DataFrame, p: IndexParams) -> DataFrame:
    """ref_id, pos, key, flank (numbers): every window whose core is a closed syncmer."""
    _fits(p)

    def columns(block: words.Block) -> pa.RecordBatch:
        at, key, forward = words.keyed(block, p)
        ref, pos = block.placed(at)
        return _batch(ref_id=ref, pos=pos, key=key[at].astype(np.int64), flank=words.flanks(block, p, at, forward))

    return _found(sequences, p.k, columns, f"ref_id {_kind(sequences)}, pos long, key long, flank long")


def counted(sequences: DataFrame, p: IndexParams) -> DataFrame:
    """key, n: counts of the keys of occurrences, and of all windows under the key EVERY. Summed in memory over blocks of windows, then over all."""
    _fits(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, every = [], 0, 0

        def summed() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            made = _batch(key=keys.astype(np.int64), n=n.astype(np.int64))
            yield from (made.slice(i, ROWS) for i in range(0, made.num_rows, ROWS))

        for batch in batches:
            for block in words.blocks(batch, p.k):
                at, key, _ = words.keyed(block, p)
                held.append(key[at])
                size, every = size + len(at), every + int(np.count_nonzero(block.ok))
                if size >= COUNTED:
                    yield from summed()
                    held, size = [], 0
        if size:
            yield from summed()
        yield _batch(key=np.array([EVERY]), n=np.array([every]))

    return _given(sequences).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def sampling(sequences: DataFrame, p: IndexParams) -> DataFrame:
    """One row: kmers, sampled, rate (null without k-mers)."""
    _fits(p)

    def columns(block: words.Block) -> pa.RecordBatch:
        return _batch(kmers=np.array([np.count_nonzero(block.ok)]), sampled=np.array([len(words.keyed(block, p)[0])]))

    total = _found(sequences, p.k, columns, "kmers long, sampled long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kmers", "sampled")])
    return total.select("kmers", "sampled", F.try_divide(F.col("sampled").cast("double"), F.col("kmers")).alias("rate"))

"""Shared pieces: reading tables, cutting lineage, tokenising bytes, output schemas."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer single texts go alone.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset; then it is a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/basewell-{uuid.uuid4().hex}"
    key, was = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    if partition_by:  # a few partitions: a writer for each, instead of sorting the rows by them
        spark.conf.set(key, "16")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(key, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empties tables that cut() wrote and nothing reads any more."""
    for t in tables:
        t.sparkSession.range(0).write.mode("overwrite").parquet(t.cut_path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of queries that are over: its cleaner waits for garbage collections, which an idle driver doesn't make. Only disk depends on it."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _row: its place from 0 in the given order. Ranges are sorted apart, and their sizes, a row per range, are summed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_in", inside).join(before, "_part").withColumn("_row", (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_before")


def lean() -> None:
    """In a worker: gives freed memory back to the system, now and, for arrays of over 1 MB, from now on as they go."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which the allocator would raise as it goes
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Byte classes of the contracts, as tables for bytes.translate.
SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
LOWER_SPACED = bytes(c + 32 if 65 <= c <= 90 else SPACED[c] for c in range(256))
LOWER_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None, table: bytes) -> list[bytes]:
    """Words of a text as UTF-8 bytes under one of the byte classes above.

    After the translation the only white space left is 0x20 and the control bytes
    0x1C-0x1F, which bytes.split() doesn't treat as white space."""
    return text.encode("utf-8", "surrogatepass").translate(table).split(b" ") if text else []


def words(text: str | None, table: bytes) -> list[bytes]:
    return [w for w in tokens(text, table) if w] if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that none holds more than about `most` bytes of text (a longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_POWER = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain): every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: np.uint64 = _POWER) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of a polynomial's odd base and of its inverse; kept by the process."""
    if len(_powers.get(int(base), ((),))[0]) < n:
        tables = []
        for x in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            t = np.full(n, x)
            t[0] = 1
            tables.append(np.cumprod(t, out=t))
        _powers[int(base)] = tuple(tables)
    power, undo = _powers[int(base)]
    return power[:n], undo[:n]


def word_hashes(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one after the other, and the number of each text's words.

    Equal words have equal hashes anywhere. Texts are hashed in buffers of about CHUNK_BYTES: longer ones are cut
    between words, so memory doesn't follow the longest text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            h, n = _buffer_hashes(parts)
            hashes.append(h)
            np.add.at(counts, owners, n)
            parts.clear()
            owners.clear()
            held = 0

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").translate(table) if t else b""
        a = 0
        while a < len(raw):
            z = len(raw)
            if z - a > CHUNK_BYTES:
                z = raw.rfind(b" ", a, a + CHUNK_BYTES) + 1 or raw.find(b" ", a + CHUNK_BYTES) + 1 or len(raw)
            if held and held + z - a > CHUNK_BYTES:
                flush()
            parts.append(raw[a:z])
            owners.append(i)
            held += z - a
            a = z
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def _buffer_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of translated texts in one buffer. Prefix sums of a polynomial over random byte values make it a few array
    operations per byte, without a Python object per word."""
    data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    edge = np.diff((data != 32).astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, undo = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], power[:-1], out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    found = (prefix[stops] - prefix[starts]) * undo[starts]
    found = mix(found + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    upto = np.searchsorted(starts, ends, "left")
    return found, np.diff(upto, prepend=0)

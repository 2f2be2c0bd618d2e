"""Sequences from DataFrames, literals and FASTA files: sequences(ref_id, name, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import running
from . import store

#: Letters of the extended nucleotide alphabet.
IUPAC = "ACGTURYSWKMBDHVN"


def from_dataframe(df: DataFrame, id_col: str, seq_col: str, name_col: str | None = None) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("ref_id"), F.col(name_col or id_col).cast("string").alias("name"), F.upper(F.col(seq_col)).alias("seq"))


def literal(spark: SparkSession, *sequences: str) -> DataFrame:
    """Sequences numbered from 1."""
    return spark.createDataFrame([(i, f"seq{i}", s) for i, s in enumerate(sequences, 1)], "ref_id long, name string, seq string")


def parse_name(header) -> F.Column:
    """The name in a header line: without its first character, up to the first space."""
    return F.split(F.expr(f"substring({header}, 2)"), " ")[0]


def validated(records: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Records with upper-case bases. Letters outside the extended alphabet raise (FAILFAST), or their records go (DROPMALFORMED)."""
    upper = records.withColumn("seq", F.upper("seq"))
    ok = F.translate("seq", IUPAC, "") == ""
    if mode == "DROPMALFORMED":
        return upper.filter(ok)
    return upper.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), F.col("name")))))


def numbered(records: DataFrame) -> DataFrame:
    """Sequences with ref_id from 1 in (file, ordinal) order, without moving their bases through one task: files' counts are summed first."""
    counts = records.groupBy("file").agg((F.max("ordinal") + 1).alias("_n"))  # one row per file; dropped records keep their numbers
    before = counts.select(F.col("file").alias("_f"), (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return records.join(before, F.col("file") == F.col("_f")).select((F.col("_before") + F.col("ordinal") + 1).alias("ref_id"), "name", "seq")


def checked_names(sequences: DataFrame) -> DataFrame:
    """The dictionary refs(ref_id, name); a repeated name raises when it is read."""
    names = sequences.groupBy("name").agg(F.min("ref_id").alias("ref_id"), F.count("*").alias("_n"))
    return names.select(F.when(F.col("_n") == 1, F.col("ref_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate reference name: "), F.col("name")))).cast("long").alias("ref_id"), "name")


def read_text(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """FASTA files of moderate size, each read whole by Spark, so from any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    records = text.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("value")), "\n>")).alias("at", "record")).filter("at > 0")
    parts = records.select("file", (F.col("at") - 1).alias("ordinal"), F.substring_index("record", "\n", 1).alias("head"), F.regexp_replace(F.expr("substring(record, length(substring_index(record, '\n', 1)) + 1)"), r"\s", "").alias("seq"))
    return numbered(validated(parts.select("file", "ordinal", F.split("head", " ")[0].alias("name"), "seq"), mode))


#: Bases of a piece, and of a chunk of a long sequence.
PIECE, CHUNK = 1 << 20, 1 << 20
_BLANK = b" \t\r\n\x0b\x0c"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of file blocks as pieces of records. A batch's lines lie one after the other in one buffer, so a record's bases are a slice of it.

    at: number of the piece in its block; head: of the block's headers so far; name, file: at the record's first piece; off: the record's bases before in the block; under: the block's bases before the record; whole: the record
    is this piece alone, as another header of the block follows."""
    names = ["f", "block", "at", "head", "file", "name", "off", "under", "whole", "seq"]
    out: list[tuple] = []
    held = 0
    of, at, head, file, name, off, under, parts, size = None, 0, 0, None, None, 0, 0, [], 0

    def table() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    def piece(ends: bool) -> None:
        nonlocal at, name, file, off, under, parts, size, held
        if size or name is not None:
            out.append((*of, at, head, file, name, off, under, ends and name is not None, b"".join(parts).decode("utf-8", "replace")))
            at, held = at + 1, held + size
        name, file, off, parts, size = None, None, off + size, [], 0
        if ends:
            under, off = under + off, 0

    for batch in batches:
        lines = batch.column("value")
        offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2] or b"")
        f, block = batch.column("f").to_numpy(), batch.column("block").to_numpy()
        new = set(np.flatnonzero((np.diff(f) != 0) | (np.diff(block) != 0)) + 1) | {0}
        heads = pc.is_valid(batch.column("file")).to_numpy(zero_copy_only=False)
        stops = np.unique([*new, *np.flatnonzero(heads), len(lines)])
        for a, z in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            if a in new and of != (int(f[a]), int(block[a])):
                if of is not None:
                    piece(False)
                of, at, head, off, under = (int(f[a]), int(block[a])), 0, 0, 0, 0
            if heads[a]:
                piece(True)
                head, name, file = head + 1, lines[a].as_py()[1:].split(" ")[0], batch.column("file")[a].as_py()
                a += 1
            bases = bytes(data[offsets[a] : offsets[z]]).translate(None, _BLANK) if a < z else b""
            parts.append(bases)
            size += len(bases)
            if size >= PIECE:
                piece(False)
        if held >= 4 * PIECE or len(out) > 20_000:
            yield table()
            out, held = [], 0
    if of is not None:
        piece(False)
    if out:
        yield table()


def pieces(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """ref_id, name (of a record's first piece), start, seq, whole (no other piece has the record's bases): FASTA files of any size, from any store that Spark reads.

    Spark's text reader splits the files into byte ranges (of split_bytes, or as the session says) at line ends, also inside a record. Every range is parsed once and its pieces are written in the shared
    folder; records are numbered from 1 in the order of files' names, and their bases placed, by prefix sums over the ranges."""
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        if split_bytes:
            spark.conf.set(key, str(split_bytes))
        return pieces_of(_lines(spark.read.option("recursiveFileLookup", "true").text(path)))
    finally:
        spark.conf.set(key, was)


def _lines(text: DataFrame) -> DataFrame:
    file, header = F.col("_metadata.file_path"), F.startswith("value", F.lit(">"))
    return text.select(F.xxhash64(file).alias("f"), F.col("_metadata.file_block_start").alias("block"), F.when(header, file).alias("file"), "value")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The lines of the FASTA files of a folder as a stream: a file belongs to one micro-batch, whose pieces `pieces_of` makes."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    return _lines((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path))


def pieces_of(lines: DataFrame) -> DataFrame:
    """`pieces` of files' lines (f, block, file of a header line, value), as Spark's text reader gives them."""
    raw = store.written(lines.mapInArrow(_cut, "f long, block long, at long, head long, file string, name string, off long, under long, whole boolean, seq string"))
    blocks = raw.groupBy("f", "block").agg(F.max("head").alias("heads"), F.sum(F.length("seq")).alias("bases"), F.max("under").alias("last"), F.max("file").alias("file"))
    files = blocks.groupBy("f").agg(F.max("file").alias("file"), F.min(F.when(F.col("heads") > 0, F.col("block"))).alias("first"))
    known = blocks.drop("file").join(files.filter("file is not null"), "f").filter("block >= first")  # what stands before a file's first header is no record
    placed = running.sums(known, ["file", "block"], "heads", "bases")
    opened = placed.filter("heads > 0").select((F.col("heads_before") + F.col("heads")).alias("_ref"), (F.col("bases_before") + F.col("last")).alias("_at"))
    where = placed.join(opened, F.col("heads_before") == F.col("_ref"), "left").select(F.col("f").alias("_f"), F.col("block").alias("_b"), "first", "heads_before", (F.col("bases_before") - F.col("_at")).alias("carried"))
    found = raw.join(where, (F.col("f") == F.col("_f")) & (F.col("block") == F.col("_b"))).filter((F.col("head") > 0) | (F.col("block") > F.col("first")))
    start = F.col("off") + F.when(F.col("head") == 0, F.col("carried")).otherwise(0)
    return found.select((F.col("heads_before") + F.col("head")).alias("ref_id"), "name", start.alias("start"), F.upper("seq").alias("seq"), "whole")


def checked_pieces(parts: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """`validated` for pieces: with DROPMALFORMED all pieces of a record with a bad one go; the others keep their numbers."""
    ok = F.translate("seq", IUPAC, "") == ""
    if mode == "DROPMALFORMED":
        return parts.join(parts.filter(~ok).select("ref_id").distinct(), "ref_id", "left_anti")
    who = F.coalesce("name", F.concat(F.lit("record "), F.col("ref_id").cast("string")))
    return parts.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), who))))


def chunks(parts: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """ref_id, start, seq: sequences in chunks of `size` windows of k bases, neighbours sharing k - 1 bases, so every window stands in one chunk. Records that are one piece stay as they are; of the others no task or
    row holds more than a chunk."""
    alone = parts.filter("whole").select("ref_id", "start", "seq")
    n = F.length("seq")
    first, last = F.greatest(F.floor((F.col("start") - (k - 1)) / size), F.lit(0)), F.floor((F.col("start") + n - 1) / size)
    dealt = parts.filter(~F.col("whole") & (n > 0)).select("ref_id", "start", "seq", F.explode(F.sequence(first, last)).alias("g"))
    low, high = F.greatest("start", F.col("g") * size), F.least(F.col("start") + F.length("seq"), F.col("g") * size + size + k - 1)
    cut = dealt.select("ref_id", "g", low.alias("at"), F.substring(F.col("seq"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    joined = cut.groupBy("ref_id", "g").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("v"))
    return alone.unionByName(joined.select("ref_id", (F.col("g") * size).alias("start"), F.array_join(F.transform("v", lambda x: x["seq"]), "").alias("seq")))


def names(parts: DataFrame) -> DataFrame:
    """ref_id, name of every record."""
    return parts.filter("name is not null").select("ref_id", "name")


def read_files(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int | None = None) -> DataFrame:
    """sequences(ref_id, name, seq) with a row per record, of FASTA files of any size. `chunks` of `pieces` keep long records apart."""
    parts = checked_pieces(pieces(spark, path, split_bytes), mode)
    alone = parts.filter("whole").select("ref_id", "name", "seq")
    joined = parts.filter(~F.col("whole")).groupBy("ref_id").agg(F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("start", F.length("seq").alias("n"), "seq"))).alias("v"))
    return alone.unionByName(joined.select("ref_id", "name", F.array_join(F.transform("v", lambda x: x["seq"]), "").alias("seq")))

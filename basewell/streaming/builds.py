"""An index that grows with a stream of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import IndexParams
from ..operators import index as ix
from ..operators import windows
from ..plans.build import Index
from ..sources import fasta

_TABLES = {"taken": "n long", "refs": "ref_id long, name string", "occurrences": "ref_id long, pos long, key long, flank long", "counts": "key long, n long", "over": "key long"}


def start(spark: SparkSession, source: str, path: str, p: IndexParams, mode: str = "FAILFAST", files_per_trigger: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A query that adds the FASTA files that come into `source` to the index in `path`, micro-batch by micro-batch (trigger: as for writeStream; default: all that is there, then end).

    A batch writes its own folder of each table, anew if it runs again, so a batch that failed midway counts once. Records are numbered on from the batches before. What is
    carried between batches is in tables: each batch's counts of its keys, and the keys that have passed the cap, whose later occurrences are neither shuffled nor written. A batch reads the
    counts of all keys that came before (two numbers each) but none of their occurrences; without a cap not even those.

    Defined results: a batch without records adds nothing; names that repeat in any batches raise when the dictionary is read; with DROPMALFORMED bad records go and keep their numbers."""
    for name, schema in _TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/batch=-1")

    def add(lines: DataFrame, batch: int) -> None:
        session = lines.sparkSession
        before = {name: _table(session, path, name).filter(F.col("batch") < batch) for name in _TABLES}

        def put(name: str, rows: DataFrame) -> DataFrame:
            to = f"{path}/{name}/batch={batch}"
            rows.write.mode("overwrite").option("compression", "zstd").parquet(to)
            return session.read.schema(_TABLES[name]).parquet(to)

        every = fasta.pieces_of(lines)
        parts = fasta.checked_pieces(every, mode)
        first = before["taken"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
        moved = lambda rows: rows.withColumn("ref_id", F.col("ref_id") + first)
        put("taken", every.agg(F.coalesce(F.max("ref_id"), F.lit(0)).cast("long").alias("n")))
        put("refs", moved(fasta.names(parts)))
        found = moved(windows.occurrences(fasta.chunks(parts, p.k), p))
        counted = ix.counts(put("occurrences", found.join(before["over"].select("key"), "key", "left_anti").select("ref_id", "pos", "key", "flank") if p.cap is not None else found))
        own = put("counts", counted)
        if p.cap is not None:
            known = before["counts"].select("key", "n").join(own.select("key"), "key", "left_semi")
            put("over", known.unionByName(own).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > p.cap).select("key"))

    stream = fasta.stream_lines(spark, source, files_per_trigger)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(f"{_TABLES[name]}, batch long").parquet(f"{path}/{name}")


def index_of(spark: SparkSession, path: str, p: IndexParams) -> Index:
    """The index of all batches that are done, as one over the same files: only the records' numbers follow the batches. Its statistics have no k-mers (they aren't counted batch by batch)."""
    occurrences = _table(spark, path, "occurrences").drop("batch")
    counts = _table(spark, path, "counts").groupBy("key").agg(F.sum("n").alias("n"))
    refs = fasta.checked_names(_table(spark, path, "refs").drop("batch"))
    counted = _table(spark, path, "refs").agg(F.lit(None).cast("long").alias("kmers"), F.lit(None).cast("long").alias("sampled"), F.count("*").alias("refs"))
    return Index(ix.long_index(occurrences, p, counts), ix.kept_keys(counts, p), refs, ix.stats(counted, counts, p), p)

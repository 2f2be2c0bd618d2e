"""Registered queries of the k-mer engine, with the same in SQL.

Sequences come from whole texts: their letters dealt to A C G T. `documents` are indexed, `benchmark` asks."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, sql
from ..functions.params import IndexParams
from ..operators import display, match, ranges, sketch, windows
from ..operators import index as ix
from ..sources import fasta, fastq, store
from ..streaming import builds, lookups
from . import build

#: Every window; sampled by closed syncmers; a hash layout.
FULL = IndexParams(c=11, f=16, max_range_size=64)
SAMPLED = IndexParams(c=11, f=16, s=5, max_range_size=64)
HASHED = IndexParams(c=11, f=16, s=5, layout="hash")
#: The same without a cap: every occurrence of every key is kept.
WHOLE = IndexParams(c=11, f=16)
WHOLE_SAMPLED = IndexParams(c=11, f=16, s=5)
LITERAL_CORE = "ACGTACCACAC"
LITERALS = ["ACGTACGTTTGACCAGTACGTACGTTTGACC", "TTGACCAGTACGATTTTTTTTTTTTACGTACGT", "ACG", "GGTCAAACGTACGTACTGGTCAAACGTACGT"]
LITERAL = IndexParams(c=5, f=4, s=2)


def _sequences(spark, sf_dir, table="documents", id_col="doc_id") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return fasta.from_dataframe(store.spread(df).withColumn("seq", store.derived_dna(F.col("text"))), id_col, "seq")


def _asked(spark, sf_dir) -> DataFrame:
    return _sequences(spark, sf_dir, "benchmark", "item_id")


def _occurrences(spark, sf_dir, p, asked=None) -> DataFrame:
    """Of all indexed sequences; only of the asked keys, if there are some: a key's count and cap rest on its own occurrences, so the others needn't move."""
    found = windows.occurrences(_sequences(spark, sf_dir), p)
    return found if asked is None else found.join(asked.select("key").distinct(), "key", "left_semi")


def _counts(spark, sf_dir, p) -> DataFrame:
    """The counts of all keys, written: the occurrences of whole indexes are not, as they take more than the texts, which are read again."""
    return store.written(windows.counted(_sequences(spark, sf_dir), p).filter(F.col("key") != windows.EVERY))


def _index(spark, sf_dir, p, asked=None) -> DataFrame:
    if asked is None:
        return ix.long_index(_occurrences(spark, sf_dir, p), p, _counts(spark, sf_dir, p))
    return ix.long_index(store.written(_occurrences(spark, sf_dir, p, asked)), p)


def _keys(spark, sf_dir, p, asked=None) -> DataFrame:
    return ix.kept_keys(_counts(spark, sf_dir, p) if asked is None else ix.counts(_occurrences(spark, sf_dir, p, asked)), p)


def _queries(spark, sf_dir, p) -> DataFrame:
    return match.queries_of(_asked(spark, sf_dir), p)


def _both(spark, sf_dir, p) -> tuple[DataFrame, DataFrame]:
    """The queries, and the index of their keys."""
    asked = store.written(_queries(spark, sf_dir, p))
    return asked, _index(spark, sf_dir, p, asked)


def _both_keys(spark, sf_dir, p) -> tuple[DataFrame, DataFrame]:
    """The queries, and the kept ones of their keys."""
    asked = store.written(_queries(spark, sf_dir, p))
    return asked, _keys(spark, sf_dir, p, asked)


def kmer_encode(spark, sf_dir, of=_asked):
    return windows.encoded(of(spark, sf_dir), 27)


def kmer_revcomp(spark, sf_dir, of=_asked):
    return windows.turned(of(spark, sf_dir), 27)


def kmer_spectrum(spark, sf_dir):
    return windows.spectrum_counts(_sequences(spark, sf_dir), 11)


def core_flank_split(spark, sf_dir, of=_asked):
    found = windows.kmers(of(spark, sf_dir), FULL.k)
    return found.select("ref_id", "pos", dna.middle("kmer", FULL.k, FULL.c).alias("core"), dna.flanks("kmer", FULL.k, FULL.c).alias("flank"))


def canonical_core(spark, sf_dir, of=_asked):
    return windows.occurrences(of(spark, sf_dir), FULL)


def canonical_kmer_core(spark, sf_dir, of=_asked):
    return windows.occurrences(of(spark, sf_dir), IndexParams(c=11, f=16, orient="kmer"))


def closed_syncmer_filter(spark, sf_dir, of=_asked):
    return windows.occurrences(of(spark, sf_dir), SAMPLED).select("ref_id", "pos", "key")


def sampling_rate(spark, sf_dir):
    return windows.sampling(_sequences(spark, sf_dir), SAMPLED)


def key_counts_capped(spark, sf_dir):
    return _keys(spark, sf_dir, SAMPLED)


def skipped_keys(spark, sf_dir):
    return ix.skipped_keys(_counts(spark, sf_dir, SAMPLED), SAMPLED)


def structural_cap(spark, sf_dir):
    p = IndexParams(c=7, f=16, s=3, cells_per_body=64, structural_cap=True)
    return _keys(spark, sf_dir, p)


def index_stats(spark, sf_dir):
    return build.build_index(_sequences(spark, sf_dir), SAMPLED).stats


def vrange_layout(spark, sf_dir, p=SAMPLED):
    return ix.ranges(_keys(spark, sf_dir, p), p)


def index_long(spark, sf_dir, p=SAMPLED):
    return _index(spark, sf_dir, p)


def index_slots(spark, sf_dir, p=SAMPLED):
    if p.cap is not None:
        return ix.slots(_index(spark, sf_dir, p), p).select("key", "slot", "ref_id", "pos")
    return ranges.ordered(_occurrences(spark, sf_dir, p), _counts(spark, sf_dir, p)).select("key", "slot", "ref_id", "pos")


def index_nested(spark, sf_dir, p=SAMPLED):
    found = ix.nested(_index(spark, sf_dir, p))
    line = lambda v: F.concat_ws(":", v["ref_id"].cast("string"), v["pos"].cast("string"), F.coalesce(v["flank"].cast("string"), F.lit("")))
    return found.select("key", "n", F.array_join(F.transform("values", line), ",").alias("listed"))


def whole_index_nested(spark, sf_dir):
    """The index without a cap, in pages: a row per key and 1,024 values."""
    p = WHOLE_SAMPLED
    return display.listed_pages(_occurrences(spark, sf_dir, p), _counts(spark, sf_dir, p), least=p.header_threshold)


def whole_range_format(spark, sf_dir):
    p = WHOLE_SAMPLED
    return display.shown_pages(_occurrences(spark, sf_dir, p), _counts(spark, sf_dir, p), least=p.header_threshold)


def paged_matches(spark, sf_dir):
    """Lookups over pages of posting lists, written in key order and read again."""
    asked, made = _both(spark, sf_dir, WHOLE_SAMPLED)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paged = store.written(ix.pages(made).repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page"))
    return match.all_matches(asked, ix.unpaged(paged))


def bloom_matches(spark, sf_dir):
    """Lookups whose index is made of the occurrences that pass a Bloom filter of the asked keys: nothing else is moved, however many keys are asked."""
    asked = store.written(_queries(spark, sf_dir, WHOLE_SAMPLED))
    passed = sketch.pruned(windows.occurrences(_sequences(spark, sf_dir), WHOLE_SAMPLED), store.written(sketch.bloom(asked)))
    return match.all_matches(asked, ix.long_index(store.written(passed), WHOLE_SAMPLED))


#: Quality characters for letters a to z, among them those that begin a record's lines.
QUALITIES, LEAST_QUALITY = "!+@#5I9?+@<>ABCDEFGH;:/.-J", 20


def fastq_reads(spark, sf_dir):
    """Documents as FASTQ records, written, read in splits and trimmed."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(letters, F.lit("")).alias("text"))
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), store.shared_path(spark)
    record = F.concat(F.lit("@doc"), F.col("doc_id").cast("string"), F.lit(" read\n"), store.derived_dna(F.col("text")), F.lit("\n+\n"), F.translate("text", "abcdefghijklmnopqrstuvwxyz", QUALITIES))
    docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").select(record).write.text(path)
    reads = fastq.read(spark, path, split_bytes=SPLIT)
    cut = fastq.trimmed(reads.withColumn("n", F.length("seq").cast("long")), LEAST_QUALITY)
    return cut.select("ref_id", "name", "n", F.length("seq").cast("long").alias("n_kept"), F.md5("seq").alias("seq_hash"), F.md5("qual").alias("qual_hash"))


def _saved(spark, sf_dir, p):
    """The saved and loaded index, keys and dictionary of the documents."""
    made, path = build.build_index(_sequences(spark, sf_dir), p), store.shared_path(spark)
    made.save(path)
    return store.load(spark, path)


def saved_best_match(spark, sf_dir):
    """Nearest flanks looked up in an index that was saved and loaded, with the references' names from its dictionary."""
    index, _, refs, p = _saved(spark, sf_dir, WHOLE_SAMPLED)
    found = match.best_flex_match(store.written(_queries(spark, sf_dir, p)), index)
    return match.with_names(found, refs).select("query_id", "qpos", "key", "name", "ref_id", "rpos", "dist", "ties")


def saved_matches(spark, sf_dir):
    index, _, _, p = _saved(spark, sf_dir, SAMPLED)
    return match.all_matches(store.written(_queries(spark, sf_dir, p)), index)


def saved_keys(spark, sf_dir):
    return _saved(spark, sf_dir, SAMPLED)[1]


def saved_refs(spark, sf_dir):
    return _saved(spark, sf_dir, SAMPLED)[2]


def _records(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.lit("documents").alias("file"), F.col("doc_id").alias("ordinal"), F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit(""))).alias("head"), store.derived_dna(F.col("text")).alias("seq"))


def reference_dictionary(spark, sf_dir):
    numbered = fasta.numbered(_records(spark, sf_dir).select("file", "ordinal", fasta.parse_name("head").alias("name"), "seq"))
    return fasta.checked_names(numbered)


def pack_positions(spark, sf_dir, of=_asked):
    return windows.occurrences(of(spark, sf_dir), SAMPLED).select("ref_id", "pos", dna.pack("ref_id", "pos").alias("packed"), dna.pack(F.col("ref_id") + (1 << 26), "pos", cell_mask=True).alias("cell"))


def unpack_positions(spark, sf_dir, of=_asked):
    return pack_positions(spark, sf_dir, of).select("packed", dna.unpack("packed").alias("v"), dna.unpack("cell").alias("c")).select("packed", "v.ref_id", "v.pos", F.col("c.ref_id").alias("cell_ref_id"))


def flank_hamming(spark, sf_dir, p=SAMPLED):
    met = match._met(*_both(spark, sf_dir, p)).filter("flank is not null")
    return met.select("query_id", "qpos", "ref_id", "rpos", dna.hamming("qflank", "flank").alias("dist"))


def point_lookup(spark, sf_dir, p=FULL):
    found = windows.occurrences(_sequences(spark, sf_dir), p).filter(F.col("key") == match.canonical_number(LITERAL_CORE))
    return match.lookup_word(ix.long_index(store.written(found), p), LITERAL_CORE)


def all_matches(spark, sf_dir, p=FULL):
    return match.all_matches(*_both(spark, sf_dir, p))


def lookup_join(spark, sf_dir, p=SAMPLED):
    keys = ix.ranges(_keys(spark, sf_dir, p), p)
    return _queries(spark, sf_dir, p).join(keys.select("key", "n", "v_start", "v_end"), "key").select("query_id", "qpos", "key", "n", "v_start", "v_end")


def best_flex_match(spark, sf_dir, p=FULL):
    asked, made = _both(spark, sf_dir, p)
    return match.best_flex_match(asked, store.written(made))  # which reads the index three times


def lookup_misses(spark, sf_dir, p=SAMPLED):
    return match.misses(*_both_keys(spark, sf_dir, p)).select("query_id", "qpos", "key")


def rarest_first(spark, sf_dir, p=SAMPLED):
    return match.rarest_first(*_both_keys(spark, sf_dir, p))


def match_names(spark, sf_dir, p=SAMPLED):
    refs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return match.with_names(best_flex_match(spark, sf_dir, p), refs).select("query_id", "qpos", "name", "rpos", "dist")


def range_format(spark, sf_dir, p=SAMPLED):
    return display.shown(_index(spark, sf_dir, p))


def hash_layout_truncation(spark, sf_dir):
    return _index(spark, sf_dir, HASHED).select("key", "n", "ref_id", "pos")


def index_roundtrip(spark, sf_dir, p=SAMPLED):
    return _saved(spark, sf_dir, p)[0]


def _fasta_folder(spark, sf_dir, seq=None) -> str:
    """The documents' sequences as FASTA files, lines of 60 bases, in the order of doc_id over the files' names."""
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), store.shared_path(spark)
    made = _records(spark, sf_dir).repartitionByRange(n, "ordinal").sortWithinPartitions("ordinal")
    made.select(F.concat("head", F.lit("\n"), F.regexp_replace("seq" if seq is None else seq, "(.{60})", "$1\n"))).write.text(path)
    return path


def fasta_text(spark, sf_dir):
    return fasta.read_text(spark, _fasta_folder(spark, sf_dir) + "/*.txt")


def fasta_source(spark, sf_dir):
    return fasta.read_files(spark, _fasta_folder(spark, sf_dir))


def fasta_index(spark, sf_dir):
    """From FASTA files to capped keys."""
    return build.build_files(spark, _fasta_folder(spark, sf_dir), SAMPLED).keys


#: Documents that make one long record, bytes of a split, and bases of a chunk, in the queries over long records.
CHAPTER, SPLIT, GRID, SHARED = 1000, 1 << 20, 4096, 26


def _long_records(spark, sf_dir) -> str:
    """FASTA files whose records are the sequences of 1,000 documents in a row each, of lines of 60 bases and less."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / CHAPTER).alias("chapter"), "doc_id", store.derived_dna(F.col("text")).alias("seq"))
    rows = docs.select("chapter", "doc_id", F.regexp_replace(F.coalesce("seq", F.lit("")), "(.{60})", "$1\n").alias("line"))
    heads = docs.select("chapter", F.lit(-1).cast("long").alias("doc_id"), F.concat(F.lit(">chapter"), F.col("chapter").cast("string"), F.lit(" of documents")).alias("line")).distinct()
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), store.shared_path(spark)
    heads.unionByName(rows).repartition(n, "chapter").sortWithinPartitions("chapter", "doc_id").select("line").write.text(path)
    return path


def fasta_chunks(spark, sf_dir):
    """Long records, split inside by the reader, as chunks that share 26 bases: by name, start, length and hash."""
    parts = fasta.pieces(spark, _long_records(spark, sf_dir), SPLIT)
    cut = fasta.chunks(parts.withColumn("whole", F.lit(False)), SHARED + 1, GRID)
    return cut.join(fasta.names(parts), "ref_id").select("name", "start", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("hash"))


def fasta_long_keys(spark, sf_dir):
    """Counts of an index over long records; windows reach over documents, lines and splits."""
    return build.build_files(spark, _long_records(spark, sf_dir), SAMPLED, split_bytes=SPLIT).keys


def fasta_validated(spark, sf_dir):
    """Records of whose letters z alone is no nucleotide code: those with one go."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records = docs.select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtnx").alias("seq"))
    return fasta.validated(records, "DROPMALFORMED")


def literal_index(spark, sf_dir):
    """The index of a few sequences given as text."""
    return ix.long_index(windows.occurrences(fasta.literal(spark, *LITERALS), LITERAL), LITERAL)


def table_sizes(spark, sf_dir):
    return spark.createDataFrame([(c, IndexParams(c=c).table_cells) for c in range(2, 16)], "c int, cells long")


def names_both_ways(spark, sf_dir):
    """Every document's id by its name and name by its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    refs = fasta.checked_names(fasta.from_dataframe(docs.withColumn("head", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), "doc_id", "text", "head"))
    asked = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return match.with_names(match.with_ids(asked, refs).withColumnRenamed("name", "asked"), refs).select("asked", "ref_id", "name")


def hash_finaliser(spark, sf_dir):
    return windows.occurrences(_sequences(spark, sf_dir), HASHED).select("key").distinct().select("key", dna.finalised("key").alias("hash"))


def hash_ranges(spark, sf_dir):
    return ix.ranges(_keys(spark, sf_dir, HASHED), HASHED).select("key", "n", "v_start", "v_end")


def hash_lookup_join(spark, sf_dir):
    return _queries(spark, sf_dir, HASHED).join(hash_ranges(spark, sf_dir), "key").select("query_id", "qpos", "key", "n", "v_start", "v_end")


def hash_matches(spark, sf_dir):
    return match.all_matches(*_both(spark, sf_dir, HASHED))


def bucketed_matches(spark, sf_dir):
    """Lookups against a saved index whose table and the queries' are bucketed alike, so neither is moved again."""
    name, n = f"basewell_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.save_bucketed(_index(spark, sf_dir, SAMPLED), f"{name}_index", n)
    store.save_bucketed(_queries(spark, sf_dir, SAMPLED).select("query_id", "qpos", "key", "flank", F.lit(0).alias("ref_id"), F.lit(0).alias("pos")), f"{name}_asked", n)
    return match.all_matches(spark.table(f"{name}_asked").drop("ref_id", "pos"), spark.table(f"{name}_index"))


def nested_nearest(spark, sf_dir):
    """Nearest flanks out of a key's range as one row, without a window over the matches."""
    asked, made = _both(spark, sf_dir, SAMPLED)
    met = asked.withColumnRenamed("flank", "qflank").join(ix.nested(made), "key")
    return met.select("query_id", "qpos", F.explode(match.nearest_in("values", F.col("qflank"))).alias("v")).select("query_id", "qpos", "v.ref_id", F.col("v.pos").alias("rpos"), "v.dist")


def stream_matches(spark, sf_dir):
    """The benchmark's windows as a stream of queries against a saved index, in one run over all that is there."""
    made = store.shared_path(spark)
    asked, index = _both(spark, sf_dir, SAMPLED)
    asked.repartition(4).write.parquet(f"{made}/asked")
    ix.nested(index).write.parquet(f"{made}/index")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 2).parquet(f"{made}/asked")
    found = lookups.best_matches(stream, spark.read.parquet(f"{made}/index"))
    found.writeStream.format("parquet").option("path", f"{made}/found").option("checkpointLocation", f"{made}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{made}/found")


def stream_index(spark, sf_dir):
    """The index of FASTA files that come as a stream, three to a micro-batch, by names."""
    path = store.shared_path(spark)
    builds.start(spark, _fasta_folder(spark, sf_dir), path, SAMPLED, files_per_trigger=3).awaitTermination()
    made = builds.index_of(spark, path, SAMPLED)
    return match.with_names(made.index, made.refs).select("key", "n", "name", "pos", "flank")


def sql_functions(spark, sf_dir):
    """Every window of the benchmark through the session's SQL functions."""
    sql.register(spark, SAMPLED)
    _sequences(spark, sf_dir, "benchmark", "item_id").createOrReplaceTempView("asked_sequences")
    return spark.sql("""
        with w as (select ref_id, pos, substring(seq, cast(pos as int) + 1, 27) as kmer from (select ref_id, seq, explode(sequence(0L, length(seq) - 27L)) as pos from asked_sequences where length(seq) >= 27))
        select ref_id, pos, dna_revcomp(kmer) as rc, dna_core(kmer, 11) as core, dna_flanks(kmer, 11) as flank, dna_decode(dna_encode(dna_canonical(dna_core(kmer, 11))), 11) as canonical,
               dna_hamming(dna_encode(dna_flanks(kmer, 11)), dna_encode(dna_revcomp(dna_flanks(kmer, 11)))) as dist, pack_position(ref_id, pos) as packed, unpack_position(pack_position(ref_id, pos)).pos as unpacked
        from w""")


def sql_best_match(spark, sf_dir):
    """Nearest flanks in SQL alone: the asked windows, the matches and their names."""
    asked, made = _both(spark, sf_dir, WHOLE_SAMPLED)
    refs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    sql.attach(store.written(made), WHOLE_SAMPLED, refs)
    _sequences(spark, sf_dir, "benchmark", "item_id").createOrReplaceTempView("asked_sequences")
    spark.sql("create or replace temporary view kmer_queries as select ref_id as query_id, w.pos as qpos, w.key, w.flank from (select ref_id, explode(found) as w from (select ref_id, kmer_occurrences(seq) as found from asked_sequences))")
    return spark.sql("select query_id, qpos, key, name, rpos, dist, ties from best_flex_match() join kmer_refs using (ref_id)")


_ALL = [
    stream_index, sql_functions, sql_best_match, fasta_text, fasta_source, fasta_index, fasta_validated, literal_index, table_sizes, names_both_ways, hash_finaliser, hash_ranges, hash_lookup_join, hash_matches, bucketed_matches, nested_nearest, stream_matches,
    bloom_matches, fastq_reads, fasta_chunks, fasta_long_keys, paged_matches, saved_best_match, saved_matches, saved_keys, saved_refs, whole_index_nested, whole_range_format,
    kmer_encode, kmer_revcomp, kmer_spectrum, core_flank_split, canonical_core, canonical_kmer_core, closed_syncmer_filter, sampling_rate, key_counts_capped, skipped_keys, structural_cap, index_stats, vrange_layout, index_long, index_slots,
    index_nested, reference_dictionary, pack_positions, unpack_positions, flank_hamming, point_lookup, all_matches, lookup_join, best_flex_match, lookup_misses, rarest_first, match_names, range_format, hash_layout_truncation, index_roundtrip,
]


#: Queries that stand on the index: each is also registered over one without a cap, as whole_<name>.
_INDEXED = {
    vrange_layout: WHOLE_SAMPLED, index_long: WHOLE_SAMPLED, index_slots: WHOLE_SAMPLED, flank_hamming: WHOLE_SAMPLED, point_lookup: WHOLE, all_matches: WHOLE, lookup_join: WHOLE_SAMPLED, best_flex_match: WHOLE,
    lookup_misses: WHOLE_SAMPLED, rarest_first: WHOLE_SAMPLED, match_names: WHOLE_SAMPLED, index_roundtrip: WHOLE_SAMPLED,
}


#: Steps of the build: each is also registered over all indexed sequences, as indexed_<name>.
_STEPS = [kmer_encode, kmer_revcomp, core_flank_split, canonical_core, canonical_kmer_core, closed_syncmer_filter, pack_positions, unpack_positions]


def queries():
    whole = {f"whole_{f.__name__}": partial(f, p=p) for f, p in _INDEXED.items()}
    return {f.__name__: f for f in _ALL} | whole | {f"indexed_{f.__name__}": partial(f, of=_sequences) for f in _STEPS}


# --- the same in DuckDB SQL -------------------------------------------------------------------------------------------


def _code(word: str, n: int) -> str:
    return "(" + " + ".join(f"cast(instr('ACGT', substr({word}, {i + 1}, 1)) - 1 as bigint) * {4 ** (n - 1 - i)}" for i in range(n)) + ")"


def _rc(word: str) -> str:
    return f"reverse(translate({word}, 'ACGT', 'TGCA'))"


def _text(code: str, n: int) -> str:
    return " || ".join(f"substr('ACGT', cast(({code} // {4 ** (n - 1 - i)}) % 4 as integer) + 1, 1)" for i in range(n))


DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _windows(name: str, table: str, id_col: str, k: int, seq: str = DNA) -> str:
    return f"{name} as (select ref_id, cast(i as bigint) as pos, substr(seq, i + 1, {k}) as kmer from (select *, unnest(range(0, length(seq) - {k} + 1)) as i from (select {id_col} as ref_id, {seq} as seq from {table}) where length(seq) >= {k}))"


def _occ(name: str, table: str, id_col: str, p: IndexParams, raw: bool = False) -> str:
    half = p.f // 2
    flank = f"substr(kmer, 1, {half}) || substr(kmer, {half + p.c + 1}, {half})"
    parts = [_windows(f"{name}_w", table, id_col, p.k, "text" if raw else DNA)]
    if p.orient == "kmer":
        parts.append(f"{name}_o as (select ref_id, pos, least(kmer, {_rc('kmer')}) as kmer from {name}_w)")
        parts.append(f"{name}_c as (select ref_id, pos, substr(kmer, {half + 1}, {p.c}) as core, {flank} as fl from {name}_o)")
    else:
        parts.append(f"{name}_o as (select ref_id, pos, substr(kmer, {half + 1}, {p.c}) as core, {flank} as fl from {name}_w)")
        parts.append(f"{name}_c as (select ref_id, pos, least(core, {_rc('core')}) as core, case when core < {_rc('core')} then fl else {_rc('fl')} end as fl from {name}_o)")
    smers = [f"substr(core, {i + 1}, {p.s})" for i in range(p.c - p.s + 1)] if p.s else []
    keep = f" where least({', '.join(smers)}) in ({smers[0]}, {smers[-1]})" if smers else ""
    parts.append(f"{name} as (select ref_id, pos, {_code('core', p.c)} as key, {_code('fl', p.f)} as flank from {name}_c{keep})")
    return ", ".join(parts)


def _ix(p: IndexParams) -> str:
    having = f" having count(*) <= {p.cap}" if p.cap is not None else ""
    return (
        f"{_occ('d', 'documents', 'doc_id', p)}, keys as (select key, count(*) as n from d group by key{having}), "
        f"ix as (select key, n, ref_id, pos, case when n > {p.header_threshold} then flank end as flank from d join keys using (key))"
    )


def _q(p: IndexParams) -> str:
    return _occ("b", "benchmark", "item_id", p) + ", q as (select ref_id as query_id, pos as qpos, key, flank as qflank from b)"


_DIST = "cast(bit_count((xor(qflank, flank) | (xor(qflank, flank) >> 1)) & 1431655765) as integer)"
_BEST = (
    f"met as (select query_id, qpos, key, ref_id, pos as rpos, case when flank is not null then {_DIST} end as dist from q join ix using (key)), "
    "best as (select * from (select *, min(dist) over (partition by query_id, qpos) as least from met) where dist is not distinct from least)"
)
_SIZE = "(n + case when n > 2 then (n + 1) // 2 else 0 end)"


def oracle_sql():
    whole, steps = _sql(WHOLE, WHOLE_SAMPLED), _sql(FULL, SAMPLED, ("documents", "doc_id"))
    return _sql(FULL, SAMPLED) | {f"whole_{f.__name__}": whole[f.__name__] for f in _INDEXED} | {f"indexed_{f.__name__}": steps[f.__name__] for f in _STEPS}


def _sql(every: IndexParams, sampled: IndexParams, asked_of: tuple[str, str] = ("benchmark", "item_id")) -> dict[str, str]:
    """The SQL of all queries; those on the index over one made with `every` or `sampled`, the build's steps over the table `asked_of`."""
    full, some, hashed, whole = _ix(every), _ix(sampled), _ix(HASHED), IndexParams(c=11, f=16, orient="kmer")
    asked = _windows("w", *asked_of, 27)
    short = IndexParams(c=7, f=16, s=3, cells_per_body=64, structural_cap=True)
    packed = "((ref_id << 34) | pos)"
    cell = "(((ref_id + 67108864) << 34 | pos) & 1152921504606846975)"
    key = min(LITERAL_CORE, LITERAL_CORE[::-1].translate(str.maketrans("ACGT", "TGCA")))
    number = int(key.translate(str.maketrans("ACGT", "0123")), 4)
    layout = f"r as (select *, sum({_SIZE}) over (order by key) as z, {_SIZE} as size from keys)"
    flank16 = _text("flank", 16)
    held = _ix(HASHED)
    spans = "r as (select key, n, cast(sum(n) over (order by key) - n as bigint) as v_start, cast(sum(n) over (order by key) as bigint) as v_end from keys)"
    literals = "(values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LITERALS, 1)) + ") as v(id, text)"
    step = lambda x, factor: f"(({x}) * {factor}::uhugeint) % 18446744073709551616::uhugeint"
    shifted = lambda x: f"xor({x}, {x} // 8589934592::uhugeint)"
    more = {"fasta_text": f"select row_number() over (order by doc_id) as ref_id, 'doc' || doc_id as name, coalesce({DNA}, '') as seq from documents"}
    chapters = f"(select chapter as id, string_agg(coalesce({DNA}, ''), '' order by doc_id) as text from (select doc_id // {CHAPTER} as chapter, * from documents) group by chapter)"
    open_ix, line, page = _ix(WHOLE_SAMPLED), "ref_id || ':' || pos || ':' || coalesce(cast(flank as varchar), '')", f"cast((row_number() over (partition by key order by ref_id, pos) - 1) // {ix.PAGE} as bigint) as page"
    more |= {
        "fasta_chunks": f"with c as {chapters}, g as (select id, text, unnest(range(0, length(text), {GRID})) as start from c) select 'chapter' || id as name, start, length(substr(text, start + 1, {GRID + SHARED})) as n, md5(substr(text, start + 1, {GRID + SHARED})) as hash from g",
        "fasta_long_keys": f"with c as {chapters}, g as (select id, substr(text, start + 1, {GRID + SAMPLED.k - 1}) as text from (select id, text, unnest(range(0, length(text), {GRID})) as start from c)), {_occ('d', 'g', 'id', SAMPLED, True)} select key, count(*) as n from d group by key having count(*) <= {SAMPLED.cap}",
        "paged_matches": f"with {open_ix}, {_q(WHOLE_SAMPLED)} select query_id, qpos, key, ref_id, pos as rpos from q join ix using (key)",
        "saved_best_match": f"with {open_ix}, {_q(WHOLE_SAMPLED)}, {_BEST} select query_id, qpos, key, cast(ref_id as varchar) as name, ref_id, rpos, dist, case when dist is not null then count(*) over (partition by query_id, qpos) end as ties from best",
        "saved_matches": f"with {some}, {_q(sampled)} select query_id, qpos, key, ref_id, pos as rpos from q join ix using (key)",
        "bloom_matches": f"with {open_ix}, {_q(WHOLE_SAMPLED)} select query_id, qpos, key, ref_id, pos as rpos from q join ix using (key)",
        "fastq_reads": f"with r as (select doc_id, coalesce({DNA}, '') as seq, coalesce(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{QUALITIES}'), '') as qual from documents), t as (select *, regexp_replace(qual, '[\\x21-\\x{32 + LEAST_QUALITY:x}]+$', '') as kept from r) select row_number() over (order by doc_id) as ref_id, 'doc' || doc_id as name, length(seq) as n, length(kept) as n_kept, md5(substr(seq, 1, length(kept))) as seq_hash, md5(kept) as qual_hash from t",
        "stream_index": f"with {some} select key, n, 'doc' || ref_id as name, pos, flank from ix",
        "sql_functions": f"with {_windows('w', 'benchmark', 'item_id', 27)}, c as (select *, substr(kmer, 9, 11) as core, substr(kmer, 1, 8) || substr(kmer, 20, 8) as flank from w), d as (select *, {_code('flank', 16)} as qflank, {_code(_rc('flank'), 16)} as rflank from c) "
        f"select ref_id, pos, {_rc('kmer')} as rc, core, flank, least(core, {_rc('core')}) as canonical, {_DIST.replace('xor(qflank, flank)', 'xor(qflank, rflank)')} as dist, {packed} as packed, pos as unpacked from d",
        "sql_best_match": f"with {open_ix}, {_q(WHOLE_SAMPLED)}, {_BEST} select query_id, qpos, key, 'doc' || ref_id as name, rpos, dist, case when dist is not null then count(*) over (partition by query_id, qpos) end as ties from best",
        "saved_keys": f"with {some} select key, n from keys",
        "saved_refs": "select doc_id as ref_id, cast(doc_id as varchar) as name from documents",
        "whole_index_nested": f"with {open_ix}, p as (select *, {page} from ix) select key, n, page, string_agg({line}, ',' order by ref_id, pos) as listed from p group by key, n, page",
        "whole_range_format": f"with {open_ix}, p as (select *, {page} from ix) select key, page, string_agg(case when flank is null then '.. ' else {flank16} || ': ' end || {packed}, chr(10) order by ref_id, pos) as text, string_agg(case when flank is null then '.............. ' else {flank16} end || ': ' || ref_id || ' ' || pos, chr(10) order by ref_id, pos) as detail from p group by key, page",
        "fasta_source": more["fasta_text"],
        "fasta_index": f"with {some} select key, n from keys",
        "fasta_validated": "with r as (select doc_id as ref_id, 'doc' || doc_id as name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTNX') as seq from documents) select * from r where seq not like '%X%'",
        "literal_index": f"with {_occ('d', literals, 'id', LITERAL, True)}, keys as (select key, count(*) as n from d group by key) select key, n, ref_id, pos, case when n > 2 then flank end as flank from d join keys using (key)",
        "table_sizes": "select cast(c as integer) as c, cast(4 ** c + 4 * (4 ** c // 16) + 4 as bigint) as cells from range(2, 16) as t(c)",
        "names_both_ways": "select 'doc' || doc_id as asked, doc_id as ref_id, 'doc' || doc_id as name from documents",
        "hash_finaliser": f"with {_occ('d', 'documents', 'doc_id', HASHED)}, k as (select distinct key, cast(key as uhugeint) as x from d), a as (select key, {step(shifted('x'), 0xFF51AFD7ED558CCD)} as x from k), b as (select key, {step(shifted('x'), 0xC4CEB9FE1A85EC53)} as x from a), c as (select key, {shifted('x')} as x from b) select key, cast(case when x >= 9223372036854775808::uhugeint then cast(x as hugeint) - 18446744073709551616::hugeint else cast(x as hugeint) end as bigint) as hash from c",
        "hash_ranges": f"with {held}, {spans} select key, n, v_start, v_end from r",
        "hash_lookup_join": f"with {held}, {_q(HASHED)}, {spans} select query_id, qpos, key, n, v_start, v_end from q join r using (key)",
        "hash_matches": f"with {held}, {_q(HASHED)}, kept as (select *, row_number() over (partition by key order by ref_id, pos) - 1 as slot from ix) select query_id, qpos, key, ref_id, pos as rpos from q join kept using (key) where slot < case when n > 2 then n - (n + 2) // 3 else n end",
        "bucketed_matches": f"with {some}, {_q(sampled)} select query_id, qpos, key, ref_id, pos as rpos from q join ix using (key)",
        "stream_matches": f"with {some}, {_q(sampled)}, {_BEST} select query_id, qpos, key, ref_id, rpos, dist, case when dist is not null then count(*) over (partition by query_id, qpos) end as ties from best",
        "nested_nearest": f"with {some}, {_q(sampled)}, {_BEST} select query_id, qpos, ref_id, rpos, dist from best",
    }
    return more | {
        "kmer_encode": f"with {asked} select ref_id, pos, kmer, {_code('kmer', 27)} as key, kmer as decoded from w",
        "kmer_revcomp": f"with {asked} select ref_id, pos, kmer, {_rc('kmer')} as rc from w",
        "kmer_spectrum": f"with {_windows('w', 'documents', 'doc_id', 11)}, k as (select ref_id, {_code('least(kmer, ' + _rc('kmer') + ')', 11)} as key from w) select key, count(*) as n, count(distinct ref_id) as n_refs from k group by key",
        "core_flank_split": f"with {asked} select ref_id, pos, substr(kmer, 9, 11) as core, substr(kmer, 1, 8) || substr(kmer, 20, 8) as flank from w",
        "canonical_core": f"with {_occ('b', *asked_of, FULL)} select ref_id, pos, key, flank from b",
        "canonical_kmer_core": f"with {_occ('b', *asked_of, whole)} select ref_id, pos, key, flank from b",
        "closed_syncmer_filter": f"with {_occ('b', *asked_of, SAMPLED)} select ref_id, pos, key from b",
        "sampling_rate": f"with {_occ('d', 'documents', 'doc_id', SAMPLED)} select (select count(*) from d_c) as kmers, (select count(*) from d) as sampled, cast((select count(*) from d) as double) / nullif((select count(*) from d_c), 0) as rate",
        "key_counts_capped": f"with {some} select key, n from keys",
        "skipped_keys": f"with {_occ('d', 'documents', 'doc_id', SAMPLED)} select key, count(*) as n from d group by key having count(*) > {SAMPLED.cap}",
        "structural_cap": f"with {_ix(short)} select key, n from keys",
        "index_stats": f"with {_occ('d', 'documents', 'doc_id', SAMPLED)}, c as (select key, count(*) as n from d group by key) select (select count(*) from d_c) as kmers, (select count(*) from d) as sampled, cast((select count(*) from d) as double) / nullif((select count(*) from d_c), 0) as rate, count(*) as distinct_keys, count(*) filter (where n > {SAMPLED.cap}) as skipped_keys, cast(coalesce(sum({_SIZE}) filter (where n <= {SAMPLED.cap}), 0) as bigint) as value_cells, (select count(distinct doc_id) from documents) as refs from c",
        "vrange_layout": f"with {some}, {layout} select key, n, cast(z - size as bigint) as v_start, cast(z as bigint) as v_end, n > 2 as has_flank, cast(case when size > 2 then (size + 2) // 3 else 0 end as bigint) as header_cells, (key >> 4) * 20 as block_cell, (key >> 4) * 20 + 4 + key % 16 as key_cell from r",
        "index_long": f"with {some} select key, n, ref_id, pos, flank from ix",
        "index_slots": f"with {some} select key, row_number() over (partition by key order by ref_id, pos) - 1 as slot, ref_id, pos from ix",
        "index_nested": f"with {some} select key, n, string_agg(ref_id || ':' || pos || ':' || coalesce(cast(flank as varchar), ''), ',' order by ref_id, pos) as listed from ix group by key, n",
        "reference_dictionary": "select row_number() over (order by doc_id) as ref_id, 'doc' || doc_id as name from documents",
        "pack_positions": f"with {_occ('b', *asked_of, SAMPLED)} select ref_id, pos, {packed} as packed, {cell} as cell from b",
        "unpack_positions": f"with {_occ('b', *asked_of, SAMPLED)} select {packed} as packed, ref_id, pos, ({cell} >> 34) as cell_ref_id from b",
        "flank_hamming": f"with {some}, {_q(sampled)} select query_id, qpos, ref_id, pos as rpos, {_DIST} as dist from q join ix using (key) where flank is not null",
        "point_lookup": f"with {full} select key, n, ref_id, pos, flank from ix where key = {number}",
        "all_matches": f"with {full}, {_q(every)} select query_id, qpos, key, ref_id, pos as rpos from q join ix using (key)",
        "lookup_join": f"with {some}, {_q(sampled)}, {layout} select query_id, qpos, key, n, cast(z - size as bigint) as v_start, cast(z as bigint) as v_end from q join r using (key)",
        "best_flex_match": f"with {full}, {_q(every)}, {_BEST} select query_id, qpos, key, ref_id, rpos, dist, case when dist is not null then count(*) over (partition by query_id, qpos) end as ties from best",
        "lookup_misses": f"with {some}, {_q(sampled)} select query_id, qpos, key from q where key not in (select key from keys)",
        "rarest_first": f"with {some}, {_q(sampled)} select query_id, qpos, key, n, row_number() over (partition by query_id order by n, key, qpos) as rank from q join keys using (key)",
        "match_names": f"with {some}, {_q(sampled)}, {_BEST} select query_id, qpos, 'doc' || ref_id as name, rpos, dist from best",
        "range_format": f"with {some} select key, string_agg(case when flank is null then '.. ' else {flank16} || ': ' end || {packed}, chr(10) order by ref_id, pos) as text, string_agg(case when flank is null then '.............. ' else {flank16} end || ': ' || ref_id || ' ' || pos, chr(10) order by ref_id, pos) as detail from ix group by key",
        "hash_layout_truncation": f"with {hashed} select key, n, ref_id, pos from (select *, row_number() over (partition by key order by ref_id, pos) - 1 as slot from ix) where slot < case when n > 2 then n - (n + 2) // 3 else n end",
        "index_roundtrip": f"with {some} select key, n, ref_id, pos, flank from ix",
    }

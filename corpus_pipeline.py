"""A corpus from documents to packed token ids: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.

Defined results: null and empty texts, and those of fewer than ten words, go in the first stage, with whatever else its
rules reject. Of rows with equal texts, or near ones, one stays, that of the least doc_id; null ids come last, and equal
rows are one class. Rows with a null doc_id pass all stages. Texts of any length are taken whole; the mix cuts documents
into blocks of 2,048 words and the token rows cut them at row ends, both without loss. Extra columns of documents,
whatever their names, are carried to the mix. Without a benchmark nothing is cut; empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewell.llm import common, decontaminate, mixing, ngram_join, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays."""
    return ngram_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly made of them goes."""
    return decontaminate.cleaned(docs, common.read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their targets, in blocks that hold most documents whole, and stand in the order of drawn output shards."""
    return mixing.mixed(docs, block_words=2048, slots_per_shard=128)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of fixed length."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_rows", token_rows),
]

#: MinHash, the drawn mix and the tokenizer have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written and read again before the next."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

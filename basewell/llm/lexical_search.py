"""Operator 12: ranked lexical search as a blocked sparse matrix product.

The items' terms make the vocabulary. The documents become rows of a term-document matrix (term numbers and occurrences, packed), written once
in the shared folder; N, L and the terms' document counts are sums over it. A task takes that matrix in blocks of documents, turns its
entries into int64 impacts ordered by term, and merges, for one item after the other, the rows of the item's terms (Gustavson). It keeps each
item's `k` best documents over its blocks; those of all tasks are reduced in two steps, by (item, group of tasks) and by item.

The vocabulary and the items' rows are broadcast, in blocks of items of at most about `block_words` words (a longer item goes alone); each block
takes its own passes over the documents, so neither broadcast nor a task grows with the benchmark. Terms are told apart by 64-bit hashes; a
collision would count two words as one. ORACLE_SQL gives the same in SQL.

Defined results: a null or empty text has no terms and is in no result, though its row may have an id; an item without terms has no
results; every row is an item or a document of its own, repeated or not, so a repeated item is ranked again; a null item_id or doc_id stays null, and null doc_ids
stand last among equal scores; empty tables give empty results; very long texts are hashed in portions; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 50
#: Words of items in one broadcast.
BLOCK_WORDS = 1_000_000
#: Documents and matrix entries that a task multiplies at once.
BLOCK_DOCS, BLOCK_ENTRIES = 16_384, 2_000_000
#: Groups in which the tasks' results are reduced first.
GROUPS = 256
_LAST = np.iinfo(np.int64).max


class Items:
    """Some items' rows of the item-term matrix; every term of an item counts once."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in rows]
        hashes, counts = common.word_hashes([t for _, t in rows], common.LOWER_ALNUM)
        self.vocabulary = np.unique(hashes)
        ends = np.cumsum(counts)
        at = np.searchsorted(self.vocabulary, hashes)
        self.terms = [np.unique(at[z - n : z]) for z, n in zip(ends, counts, strict=True)]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks, streamed to the driver one partition at a time."""
    block, n = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((row["item_id"], row["text"]))
        n += len(row["text"] or "") // 2 + 1  # no text has more words than that
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def matrix(docs: DataFrame, vocabulary) -> DataFrame:
    """Per document: doc_id, n (its terms, with repeats), and of the terms in a broadcast sorted vocabulary their numbers (`terms`) and occurrences (`tfs`), four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in common.slices(batches):
            hashes, counts = common.word_hashes(batch.column("text").to_pylist(), common.LOWER_ALNUM)
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            owner = np.repeat(np.arange(len(counts)), counts)[hit]
            cells, tfs = np.unique(owner * np.int64(max(len(known), 1)) + at[hit], return_counts=True)
            row, term = np.divmod(cells, max(len(known), 1))
            edge = np.searchsorted(row, np.arange(len(counts) + 1))
            packed = lambda x: [x[a:z].astype("<i4").tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(packed(term), pa.binary()), pa.array(packed(tfs), pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """df of every term of the vocabulary, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=n_terms)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    return df


def _best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending id, nulls last."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids, null = scores[some], ids[some], null[some]
    order = np.lexsort((ids, null, -scores))[:k]
    return scores[order], ids[order], null[order]


def _product(rows: DataFrame, shared, weights: np.ndarray, n_docs: int, n_all: int, k: int, item_kind: str) -> DataFrame:
    """item, item_id, doc_id, score, task: every task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        best = [none] * len(items.ids)

        def multiply(parts: list[pa.RecordBatch]) -> None:
            sizes = np.concatenate([np.array([len(x) // 4 for x in b.column("terms").to_pylist()], np.int64) for b in parts])
            term, tf = (np.frombuffer(b"".join(x for b in parts for x in b.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("terms", "tfs"))
            n = np.concatenate([b.column("n").to_numpy() for b in parts])
            null = np.concatenate([b.column("doc_id").is_null().to_numpy(zero_copy_only=False) for b in parts])
            ids = np.concatenate([b.column("doc_id").fill_null(_LAST).to_numpy() for b in parts])
            m = 100 - 50 + (50 * n * n_docs) // n_all
            owner = np.repeat(np.arange(len(sizes)), sizes)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            order = np.argsort(term, kind="stable")
            owner, impact = owner[order], impact[order]
            edge = np.searchsorted(term[order], np.arange(len(weights) + 1))
            score = np.zeros(len(sizes), np.int64)
            for i, terms in enumerate(items.terms):
                score[:] = 0
                for t in terms:
                    a, z = edge[t], edge[t + 1]
                    if a < z:
                        score[owner[a:z]] += impact[a:z]  # a document stands once in a term's row
                least = best[i][0][-1] if len(best[i][0]) == k else 1
                some = np.flatnonzero(score >= max(least, 1))
                if len(some):
                    best[i] = _best(*(np.concatenate(x) for x in zip(best[i], (score[some], ids[some], null[some]), strict=True)), k)

        parts, docs, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                parts.append(part)
                docs += part.num_rows
                entries += sum(len(x) for x in part.column("terms").to_pylist()) // 4
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    multiply(parts)
                    parts, docs, entries = [], 0, 0
        if parts:
            multiply(parts)
        task, kind = TaskContext.get().partitionId(), pa.int64() if item_kind != "string" else pa.string()
        for at in range(0, len(best), 200):
            own = best[at : at + 200]
            of = np.repeat(np.arange(at, at + len(own)), [len(b[0]) for b in own])
            scores, ids, null = (np.concatenate(x) for x in zip(*own, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array([items.ids[i] for i in of], kind), pa.array(ids, mask=null), pa.array(scores), pa.array(np.full(len(of), task))], names=["item", "item_id", "doc_id", "score", "task"])

    return rows.filter("n > 0").mapInArrow(run, f"item long, item_id {item_kind}, doc_id long, score long, task long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    spark, found = docs.sparkSession, None
    item_kind = "string" if items.schema["item_id"].dataType.simpleString() == "string" else "bigint"
    items = items.withColumn("item_id", F.col("item_id").cast(item_kind))
    for block in _blocks(items, block_words):
        own = Items(block)
        words = spark.sparkContext.broadcast(own.vocabulary)
        rows = common.cut(matrix(docs, words))
        total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).head()
        df = document_counts(rows, len(own.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        made = _product(rows, spark.sparkContext.broadcast(own), weights, total["docs"], total["words"], k, item_kind)
        found = _reduced(made, k) if found is None else found.unionByName(_reduced(made, k))
    return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long") if found is None else found


def _reduced(made: DataFrame, k: int) -> DataFrame:
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    some = made.withColumn("part", F.pmod("task", F.lit(GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same rows in DuckDB SQL.
ORACLE_SQL = f"""
with d as (select doc_id, unnest({_WORDS}) as term from documents),
q as (select distinct item_id, term from (select item_id, unnest({_WORDS}) as term from benchmark)),
sizes as (select doc_id, count(*) as n from d group by doc_id),
whole as (select count(*) as n_docs, cast(sum(n) as bigint) as n_all from sizes),
tf as (select doc_id, term, count(*) as tf from d where term in (select term from q) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::double)) as bigint) as w from df, whole),
m as (select doc_id, 50 + (50 * n * n_docs) // n_all as m from sizes, whole),
i as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) as impact from tf join w using (term) join m using (doc_id)),
s as (select item_id, doc_id, cast(sum(impact) as bigint) as score from q join i using (term) group by item_id, doc_id having sum(impact) > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 50
"""

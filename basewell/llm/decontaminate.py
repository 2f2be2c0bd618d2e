"""Operator 6: benchmark decontamination by word windows.

The benchmark's windows of `window` words (an item of fewer words, but not none, is one window)
make a hash set that is broadcast; every document's word windows are hashed, looked up in it and
verified word by word, and the words of verified windows are hit. The set is broadcast in blocks of at most
`block_words` benchmark words (an item of more goes alone), one pass over the documents per block, so the broadcast stays
bounded however large the benchmark is; each pass adds to the marks of the ones before, on the uncut text.

Defined results: null texts have no words; an item without words hits nothing; an item that occurs
several times counts once; a repeated item_id counts once per distinct id; a null item_id is
not listed. A null doc_id stays null. Empty tables give empty results or no hits. Repeated doc_ids
stay separate rows. Very long texts are taken whole. Extra columns are ignored by `scan` and kept by `cleaned`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Words of benchmark text in one broadcast set: about 100 bytes each in the index below.
BLOCK_WORDS = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """The windows of some benchmark items: vocabulary, and per window length a sorted hash array with the windows' words and items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, list[tuple[tuple[int, ...], object]]] = {}
        self.items: list[object] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in common.words(text, common.LOWER_ALNUM)]
            if ids:
                size = min(window, len(ids))
                at = len(self.items)
                self.items.append(item_id)
                found.setdefault(size, []).extend((w, at) for w in {tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)})
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for size, windows in found.items():
            owners: dict[tuple[int, ...], list[int]] = {}
            for w, at in windows:
                owners.setdefault(w, []).append(at)
            table = np.array(list(owners), dtype=np.uint32).reshape(-1, size)
            hashes = self.rolled(table.reshape(-1), size)[::size]
            order = np.argsort(hashes, kind="stable")
            lists = list(owners.values())
            self.sizes[size] = hashes[order], table[order], [lists[i] for i in order]

    @staticmethod
    def rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of `size` ids, by polynomial doubling."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = ids[:n].astype(np.uint64)
        for k in range(1, size):
            out *= _MULT
            out ^= out >> np.uint64(29)
            out += ids[k : n + k]
        return out

    def hits(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words are hit, and the (text, item) pairs, for the concatenated ids of some texts; owner: each word's text."""
        hit = np.zeros(len(ids) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        known = ids > 0
        for size, (hashes, table, owners) in self.sizes.items():
            if len(ids) < size:
                continue
            # only where `size` words in a row, of one text, are benchmark words can a window stand
            run = np.concatenate([[0], np.cumsum(known)])
            starts = np.flatnonzero((run[size:] - run[:-size] == size) & (owner[: len(ids) - size + 1] == owner[size - 1 :]))
            if not len(starts):
                continue
            h = self.rolled(ids, size)[starts]
            low = np.searchsorted(hashes, h, "left")
            ok = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h))
            for i in ok:
                s = starts[i]
                j = low[i]
                while j < len(hashes) and hashes[j] == h[i]:  # equal hashes: the words decide
                    if np.array_equal(table[j], ids[s : s + size]):
                        hit[s] += 1
                        hit[s + size] -= 1
                        t = int(owner[s])
                        pairs.update((t, x) for x in owners[j])
                    j += 1
        return np.cumsum(hit[:-1]) > 0, sorted(pairs)


def _ids(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get, out, sizes = vocabulary.get, [], []
    for t in texts:
        own = [get(w, 0) for w in common.tokens(t, common.LOWER_ALNUM) if w]
        out += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    return np.array(out, np.uint32), np.repeat(np.arange(len(texts)), sizes), sizes


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most about block_words words, streamed to the driver one partition at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        n += len(row["t"] or "") // 2 + 1  # no text has more words than that
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _hits(batch: pa.RecordBatch, index: Index, marks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Which words are hit, by this block or by marks of earlier ones; each word's text; the texts' numbers of words; (text, item) pairs of this block."""
    ids, owner, sizes = _ids(batch.column("text").to_pylist(), index.vocabulary)
    hit, pairs = index.hits(ids, owner)
    if marks in batch.schema.names:
        first = np.cumsum(sizes) - sizes
        for t, runs in enumerate(batch.column(marks).to_pylist()):
            for a, z in zip(runs[::2], runs[1::2], strict=True):
                hit[first[t] + a : first[t] + z] = True
    return hit, owner, sizes, pairs


def _marked(docs: DataFrame, index, marks: str, listed: str, counted: str, keep_text: bool = True) -> DataFrame:
    """docs with the runs of hit words ([start, stop) by word number, flattened), the items (ids) and the number of words; the first two joined with those of earlier blocks."""
    names = [c for c in docs.columns if c not in (marks, listed, counted) and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in common.slices(batches):
            hit, owner, sizes, pairs = _hits(batch, found, marks)
            items = [set(x) for x in batch.column(listed).to_pylist()] if listed in batch.schema.names else [set() for _ in range(batch.num_rows)]
            for t, i in pairs:
                if found.items[i] is not None:
                    items[t].add(found.items[i])
            first, runs = np.cumsum(sizes) - sizes, [[] for _ in range(batch.num_rows)]
            for t in np.unique(owner[hit]):
                runs[t] = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[t] : first[t] + sizes[t]].astype(np.int8), [0]]))).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(sizes)], names=[*names, marks, listed, counted])

    added = [T.StructField(marks, T.ArrayType(T.LongType())), T.StructField(listed, T.ArrayType(T.StringType())), T.StructField(counted, T.LongType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *added]))


def _all_but_last(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, *names: str):
    """(docs marked by every block but the last, the last block's broadcast index or None). Between blocks the marked documents are written out, and
    the block's index is given up: executors hold one at a time."""
    index = None
    for block in _blocks(benchmark, block_words):
        if index is not None:
            docs = common.cut(_marked(docs, index, *names))
            index.destroy()
        index = docs.sparkSession.sparkContext.broadcast(Index(block, window))
    return docs, index


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, items (sorted ids of items with occurring windows), hit (runs of hit words [start, stop), flattened)."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    slim, index = _all_but_last(slim, benchmark, window, block_words, "hit", "items", "n_words")
    index = index or docs.sparkSession.sparkContext.broadcast(Index([], window))
    return _marked(slim, index, "hit", "items", "n_words", keep_text=False).select("doc_id", "n_words", "items", "hit")


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The contract's columns of each document."""
    found = scan(docs, benchmark, **params)
    n_hit = F.aggregate(F.transform("hit", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "items"
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the hit words cut from their texts (from a span's first byte to its last word's end), in one pass per block.

    A document of whose words over `drop_share` are hit goes, as does none without a hit. A column
    n_chars, if there is one, follows the new text. Every block is looked for in the whole text: passes only mark, and the last
    one cuts what any has marked, so blocks don't change the result."""
    marks = common.fresh(docs, "_marks")
    out, index = _all_but_last(docs, benchmark, window, block_words, marks, common.fresh(docs, "_items"), common.fresh(docs, "_words"))
    return docs if index is None else _cut_hits(out, index, marks, docs, drop_share)


def _cut_hits(docs: DataFrame, index, marks: str, like: DataFrame, drop_share: float) -> DataFrame:
    names = like.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            hit, owner, sizes, _ = _hits(batch, index.value, marks)
            batch, touched = batch.select(names), np.unique(owner[hit])
            if not len(touched):
                yield batch
                continue
            first, keep = np.cumsum(sizes) - sizes, np.ones(batch.num_rows, bool)
            for t in touched:
                own = hit[first[t] : first[t] + sizes[t]]
                if own.sum() > drop_share * sizes[t]:
                    keep[t] = False
                else:
                    texts[t] = _without(texts[t], own)
            columns = list(batch.columns)
            at = {f.name.lower(): i for i, f in enumerate(batch.schema)}
            columns[at["text"]] = pa.array(texts, batch.schema.field(at["text"]).type)
            if "n_chars" in at and pa.types.is_integer(batch.schema.field(at["n_chars"]).type):
                lengths, was = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(at["n_chars"]).type), columns[at["n_chars"]]
                changed = np.zeros(batch.num_rows, bool)
                changed[touched] = True
                columns[at["n_chars"]] = pc.if_else(pa.array(changed), lengths, was)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, like.schema)


def _without(text: str, hit: np.ndarray) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(common.LOWER_ALNUM), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(turns[::2], turns[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = stops[b - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


ORACLE_SQL = r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') as w from low),
i as (
  select item_id, w, least(10, len(w)) as n from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark
  ) where len(w) > 0
),
iw as (select distinct item_id, n, array_to_string(w[a : a + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as a from i)),
dw as (
  select doc_id, n, a, array_to_string(w[a : a + n - 1], ' ') as s
  from (select d.doc_id, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) as a from d, (select distinct n from i) as z)
),
hit as (select doc_id, dw.n, a, item_id from dw join iw on iw.n = dw.n and iw.s = dw.s),
words as (select doc_id, count(*) as c from (select distinct doc_id, unnest(range(a, a + n)) as p from (select distinct doc_id, n, a from hit)) group by doc_id),
items as (select doc_id, count(*) as c, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from hit where item_id is not null) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(words.c, 0) as n_hit, coalesce(items.c, 0) as n_items,
       sha256(coalesce(items.s, '')) as items_sha256, words.c is not null as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

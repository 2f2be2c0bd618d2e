"""Operator 10: language-model scoring by Katz backoff.

A bigram model over the words of the lower-cased text ([^ \\t-\\r]+) and one end token per text, learned from the rows
that aren't held out. Seen bigrams have P(b|a) = d(c(ab)) c(ab) / (c(a) + PSEUDO), unseen ones alpha(a) P(b), with
Good-Turing discounts d up to count `k` and alpha(a) set so that the probabilities after a sum to exactly 1;
single words are discounted in the same way and what is left goes to one unknown word. The one that is added to a
context's total leaves mass for unseen words where every follower is frequent. An unknown context
leaves P(b).

How it runs: words are 64-bit hashes. Each map batch sends its token pairs, packed, to buckets by predicted word (the few
words that would overfill a bucket are split by the context too). A bucket counts its pairs and
words, writes the bigram counts, and leaves for each document what the score is linear in: sums of logarithms and how many
tokens fall under each discount, so the discounts can follow. Only unseen pairs travel on, to
meet alpha by context. The tables (counts, by kind; backoff weights) are written in the shared folder. `Model.save` keeps them, in ranges of
contexts and words, and `Model.score` evaluates a model on other documents by joins with them.

Defined results: a null or empty text is its end token alone. A null doc_id is learned from. Without
training rows every token is unknown, with probability 1. Repeated rows are learned from and scored each. Texts of any length are taken whole:
a batch ends with the text that takes it to BATCH_TOKENS. Counts decide nothing by rank, so ties need no order. Extra columns, whatever their names, are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 5
PSEUDO = 1
#: Text bytes per bucket, how many parts a bucket is counted in, one after the other, and tokens per packed batch.
BUCKET_BYTES = 24 << 20
PARTS = 5
BATCH_TOKENS = 1_500_000
END, START = np.uint64(1), np.uint64(2)  # no word is hashed to these but by a chance of 2**-63
_U = np.uint64



def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _token_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """(tokens with ends, tokens per document, doc_ids, held) of up to about `most` tokens."""
    common.lean()
    parts: list[tuple] = []
    held_n = 0
    for batch in common.slices(batches, most=1 << 20):
        h, n = common.word_hashes(batch.column("text").to_pylist(), common.LOWER_SPACED)
        h[h <= START] += _U(3)
        parts.append((np.insert(h, np.cumsum(n), END), n + 1, batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False)))
        held_n += len(h)
        if held_n >= most:
            yield _joined(parts)
            parts, held_n = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple]) -> tuple:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.chunked_array([p[2] for p in parts]).combine_chunks(), np.concatenate([p[3] for p in parts])


def _frequent(docs: DataFrame, buckets: int) -> dict[int, int]:
    """Words that hold over 1/(8 * buckets) of some batch, so every word that is so frequent overall, with their training counts: at most 8 * buckets of those that are frequent overall stay."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, *_ in _token_batches(batches, BATCH_TOKENS):
            w, c = np.unique(tokens, return_counts=True)
            often = c * 8 * buckets >= len(tokens)
            yield pa.RecordBatch.from_pydict({"w": pa.array(np.append(w[often], _U(0)).astype(np.int64)), "c": pa.array(np.append(c[often], len(tokens)))})

    rows = docs.mapInArrow(some, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    total = rows.filter("w = 0").agg(F.sum("c")).collect()[0][0] or 0
    words = np.array(sorted(r["w"] for r in rows.filter((F.col("w") != 0) & (F.col("c") * 8 * buckets >= total)).collect()), np.int64).astype(_U)
    if not len(words):
        return {}
    words.sort()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(words), np.int64)
        for tokens, n, _, held in _token_batches(batches, BATCH_TOKENS):
            own = tokens[np.repeat(~held, n)]
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            sums += np.bincount(at[words[at] == own], minlength=len(words))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(words)), pa.int32()), "c": pa.array(sums)})

    return {int(words[r["i"]]): r["c"] for r in docs.mapInArrow(count, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}


_BLOB = "bucket int, batch long, n_docs int, contexts binary, runs binary, words binary, word binary, doc binary, held binary, ids binary"


def _pairs(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packed (context, word, document) triples by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for tokens, n, ids, held in _token_batches(batches, BATCH_TOKENS):
            known, at = np.unique(np.append(tokens, START), return_inverse=True)
            word = at[:-1].astype(np.int32)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[np.cumsum(n) - n] = at[-1]
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            mixed = common.mix(known)
            bucket = (mixed % _U(buckets)).astype(np.int32)[word]
            split = np.isin(known, frequent)[word]
            bucket[split] = (common.mix(mixed[word[split]] + known[context[split]]) % _U(buckets)).astype(np.int32)
            order = np.argsort((bucket.astype(np.int64) << 32) | context)
            bucket, context, word, doc = bucket[order], context[order], word[order], doc[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            small = np.uint16 if len(n) <= 65536 else np.uint32
            described = pa.record_batch([ids, pa.array(held), pa.array(n)], names=["doc_id", "held", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, described.schema) as w:
                w.write_batch(described)
            for b in range(buckets):
                a, z = edges[b], edges[b + 1]
                mine = b == number % buckets  # one bucket carries the batch's ids
                if a == z and not mine:
                    continue
                first = np.flatnonzero(np.diff(context[a:z], prepend=-1))
                words, inner = np.unique(word[a:z], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([len(n)], pa.int32()),
                        pa.array([known[context[a:z][first]].tobytes()], pa.binary()), pa.array([_pack(np.diff(np.append(first, z - a)).astype(np.uint32))], pa.binary()),
                        pa.array([known[words].tobytes()], pa.binary()), pa.array([_pack(inner.astype(np.uint16 if len(words) <= 65536 else np.uint32))], pa.binary()),
                        pa.array([_pack(doc[a:z].astype(small))], pa.binary()), pa.array([np.packbits(held).tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes() if mine else None], pa.binary()),
                    ],
                    names=[x.split()[0] for x in _BLOB.split(", ")],
                )
            del known, at, word, context, doc, bucket, order, mixed, split
            common.lean()
            number += 1

    return docs.mapInArrow(run, _BLOB)


_OUT = "kind string, context long, word long, n long, n_word long, batch long, doc int, blob binary, base binary, ids binary"
_TYPES = {"kind": pa.string(), "context": pa.int64(), "word": pa.int64(), "n": pa.int64(), "n_word": pa.int64(), "batch": pa.int64(), "doc": pa.int32(), "blob": pa.binary(), "base": pa.binary(), "ids": pa.binary()}


def _rows(kind: str, n: int, /, **columns) -> list[pa.Table]:
    """n rows of a kind, in pieces that are sent as batches."""
    if not n:
        return []
    whole = pa.table([pa.array([kind] * n) if x == "kind" else pa.array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in _TYPES.items()], names=list(_TYPES))
    return [whole.slice(a, 1 << 15) for a in range(0, n, 1 << 15)]


def _part(rows: list[dict], part: int, parts: int) -> tuple[np.ndarray, ...]:
    """Of one bucket's triples those whose word belongs to the part: known contexts and words, and per triple the numbers of its context, word and document, and whether it is learned from."""
    contexts, words, context, word, doc, train = [], [], [], [], [], []
    base = n_contexts = n_words = 0
    for r in rows:
        own = np.frombuffer(r["words"], _U)
        inner = _unpack(r["word"], np.uint16 if len(own) <= 65536 else np.uint32)
        mine = np.flatnonzero(((common.mix(own + _U(7)) >> _U(33)) % _U(parts) == part)[inner]) if parts > 1 else np.arange(len(inner))
        firsts = np.frombuffer(r["contexts"], _U)
        contexts.append(firsts)
        words.append(own)
        context.append((np.repeat(np.arange(len(firsts), dtype=np.int32), _unpack(r["runs"], np.uint32)) + n_contexts)[mine])
        word.append(inner[mine].astype(np.int32) + n_words)
        d = _unpack(r["doc"], np.uint16 if r["n_docs"] <= 65536 else np.uint32)[mine]
        train.append(np.unpackbits(np.frombuffer(r["held"], np.uint8), count=r["n_docs"])[d] == 0)
        doc.append(d.astype(np.int64) + base)
        base, n_contexts, n_words = base + r["n_docs"], n_contexts + len(firsts), n_words + len(own)
    known_c, at_c = np.unique(np.concatenate(contexts), return_inverse=True)
    known_w, at_w = np.unique(np.concatenate(words), return_inverse=True)
    return known_c, known_w, at_c.astype(np.int32)[np.concatenate(context)], at_w.astype(np.int32)[np.concatenate(word)], np.concatenate(doc), np.concatenate(train)


def _count(frequent: dict[int, int], k: int, parts: int):
    """One bucket, part by part: rows of kind counts (context, word, n, n_word), words and pairs (counts of counts), unseen (context, batch, doc, n), docs (packed sums)."""
    hot = np.array(sorted(frequent), _U)
    hot_counts = np.array([frequent[int(x)] for x in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        table = pa.Table.from_batches(list(batches)).sort_by("batch")
        blobs = [c for c, t in zip(table.column_names, table.schema.types, strict=True) if t == pa.binary()]
        # the packed arrays stay where they are: only views are taken
        rows = [r | {c: x.as_buffer() for c, x in zip(blobs, own, strict=True)} for r, own in zip(table.drop_columns(blobs).to_pylist(), zip(*(table.column(c) for c in blobs), strict=True), strict=True)]
        at_doc = np.cumsum([0, *[x["n_docs"] for x in rows]])
        numbers = np.array([x["batch"] for x in rows], np.int64)
        out: list[pa.Table] = []
        sums: list[tuple] = []
        few = {"words": np.zeros(k + 3, np.int64), "pairs": np.zeros(k + 3, np.int64)}
        for part in range(parts):
            for x in out:  # each part's rows go before the next one is read
                yield from x.to_batches()
            out = []
            common.lean()
            known_c, known_w, c, w, doc, train = _part(rows, part, parts)
            if not len(c):
                continue
            # counts of words; the frequent ones' come from all buckets
            n_word = np.bincount(w[train], minlength=len(known_w))
            is_hot = np.zeros(len(known_w), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, known_w), len(hot) - 1)
                is_hot = hot[place] == known_w
                n_word = np.where(is_hot, hot_counts[place], n_word)
            keys, at = np.unique(c.astype(np.int64) * len(known_w) + w, return_inverse=True)
            at = at.astype(np.int32)
            n_pair = np.bincount(at[train], minlength=len(keys))
            r, s = n_pair.astype(np.int32)[at], n_word[w]
            seen = r > 0
            present, d = np.unique(doc, return_inverse=True)
            per = lambda where, weight=None: np.bincount(d[where], None if weight is None else weight[where], minlength=len(present))  # noqa: B023, E731
            log = lambda x: np.log10(np.maximum(x, 1))
            ints = [per(s > 0), *(per(r == i) for i in range(1, k + 1)), *(per(~seen & (s == i)) for i in range(1, k + 1)), per(~seen & (s > 0)), per(~seen & (s == 0))]
            sums.append((present, np.stack(ints).astype(np.int32), np.stack([per(slice(None), np.log10(s + 1.0)), per(seen, log(r)), per(~seen, log(s))])))
            kept = n_pair > 0
            kc, kw = keys[kept] // len(known_w), keys[kept] % len(known_w)
            out += _rows("counts", len(kc), context=known_c[kc].astype(np.int64), word=known_w[kw].astype(np.int64), n=n_pair[kept], n_word=n_word[kw])
            for kind, x in (("words", n_word[~is_hot & (n_word > 0)]), ("pairs", n_pair[kept])):
                few[kind] += np.append(np.bincount(np.minimum(x, k + 2), minlength=k + 3)[1:], x.sum())
            pair, times = np.unique(c[~seen] * len(present) + d[~seen], return_counts=True) if len(present) * len(known_c) < 1 << 31 else np.unique(c[~seen].astype(np.int64) * len(present) + d[~seen], return_counts=True)
            on = present[pair % len(present)]
            of = np.searchsorted(at_doc, on, "right") - 1
            out += _rows("unseen", len(of), context=known_c[pair // len(present)].astype(np.int64), batch=numbers[of], doc=(on - at_doc[of]).astype(np.int32), n=times)
            del known_c, known_w, c, w, doc, train, keys, at, n_pair, r, s, seen, d, kept, kc, kw, pair, times, on, of
        for kind, x in few.items():
            out += _rows(kind, k + 3, n=x, word=np.arange(1, k + 4))
        docs, ints, reals = np.zeros(0, np.int64), np.zeros((_ints(k), 0), np.int32), np.zeros((3, 0))
        if sums:
            every = np.concatenate([x[0] for x in sums])
            docs, at = np.unique(every, return_inverse=True)
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(docs)))
            ints, reals = (np.add.reduceat(np.concatenate([x[i] for x in sums], axis=1)[:, order], first, axis=1) for i in (1, 2))
        cuts = np.searchsorted(docs, at_doc)
        blobs, bases = [], []
        for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            blobs.append(_pack(np.concatenate([(docs[a:z] - at_doc[i]).astype(np.int32), ints[:, a:z].astype(np.int32).reshape(-1)])))
            bases.append(reals[0, a:z].tobytes() + reals[1:, a:z].astype(np.float32).tobytes())
        out += _rows("docs", len(rows), batch=numbers, doc=np.diff(cuts), blob=blobs, base=bases, ids=[x["ids"] and x["ids"].to_pybytes() for x in rows])
        for x in out:
            yield from x.to_batches()

    return run


def discounts(counts_of: list[int]) -> list[float]:
    """d(1..k) by Good-Turing with Katz's cut at k, from the numbers of items counted 1..k+1 times.

    Where the estimate isn't in (0, 1) for every count, a lower cut is tried, and without any, half a count is taken off each."""
    k = len(counts_of) - 1
    for cut in range(k, 0, -1):
        n = [0, *counts_of[: cut + 1]]
        if min(n[1:]) <= 0:
            continue
        share = (cut + 1) * n[cut + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if share != 1 else 0 for r in range(1, cut + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (k - cut)
    return [1 - 0.5 / r for r in range(1, k + 1)]


def _discounted(n: str, d: list[float]) -> Column:
    out = F.col(n).cast("double")
    for r, x in enumerate(d, 1):
        out = F.when(F.col(n) == r, F.lit(r * x)).otherwise(out)
    return out


def _text_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, context, word, n): how often each pair of tokens stands in the text of hashes a and b; a text's pairs come from one slice, as slices hold whole texts."""
    common.lean()
    for batch in common.slices(batches, most=1 << 20):
        h, n = common.word_hashes(batch.column("text").to_pylist(), common.LOWER_SPACED)
        h[h <= START] += _U(3)
        word = np.insert(h, np.cumsum(n), END)
        context = np.append(START, word[:-1])
        context[np.cumsum(n + 1)[:-1]] = START
        text = np.repeat(np.arange(len(n)), n + 1)
        order = np.lexsort((word, context, text))
        word, context, text = word[order], context[order], text[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(text)))
        hashes = batch.select(["a", "b"]).take(pa.array(text[first]))
        out = pa.table([*hashes.columns, pa.array(context[first].astype(np.int64)), pa.array(word[first].astype(np.int64)), pa.array(times)], names=["a", "b", "context", "word", "n"])
        yield from out.to_batches(max_chunksize=1 << 16)


_PROBE = ["a", "word", "été", "x" * 40]
_ABOUT = "word_discounts array<double>, pair_discounts array<double>, tokens long, vocabulary long, unknown double, probe array<long>"


def _probe() -> list[int]:
    """Hashes of some fixed words: a saved model fits only where words are hashed as they were when it was learned."""
    return common.word_hashes(_PROBE, common.LOWER_SPACED)[0].astype(np.int64).tolist()


@dataclass
class Model:
    """counts: bigrams (context, word, n, n_word); backoff: context, n_context, log10 alpha. Words are hashes. scores: the documents it was fitted on (None where loaded). The rest describes the single words."""

    counts: DataFrame
    backoff: DataFrame
    scores: DataFrame | None
    word_discounts: list[float]
    pair_discounts: list[float]
    tokens: int
    vocabulary: int
    unknown: float

    def save(self, path: str) -> None:
        """Writes the model as Parquet under path, which must not hold one yet: counts in ranges of (context, word), so a frequent context is spread, backoff in ranges of contexts."""
        spark = self.counts.sparkSession
        self.counts.repartitionByRange("context", "word").sortWithinPartitions("context", "word").write.parquet(f"{path}/counts")
        self.backoff.repartitionByRange("context").sortWithinPartitions("context").write.parquet(f"{path}/backoff")
        about = (self.word_discounts, self.pair_discounts, self.tokens, self.vocabulary, self.unknown, _probe())
        spark.createDataFrame([about], _ABOUT).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        about = spark.read.parquet(f"{path}/about").collect()[0].asDict()  # one row
        if about.pop("probe") != _probe():
            raise ValueError("the model was learned with other hashes of words")
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/backoff"), None, **about)

    def score(self, docs: DataFrame) -> DataFrame:
        """Per row of docs: doc_id, n_tokens and score, the log10 probability of its text; every text counts as one that wasn't learned from.

        Equal texts are scored once. Pairs of tokens meet the counts by (context, word), the others by word, and backoff by context."""
        keyed = docs.select("doc_id", common.text_or_empty().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b"))
        # n is the same in every row of a text, so the most is one row's
        pairs = keyed.select("a", "b", "text").mapInArrow(_text_pairs, "a long, b long, context long, word long, n long").groupBy("a", "b", "context", "word").agg(F.max("n").alias("n"))
        words = self.counts.select("word", "n_word").distinct()
        whole = self.tokens + PSEUDO if self.tokens else 1.0
        alone = F.coalesce(F.log10(_discounted("n_word", self.word_discounts) / whole), F.lit(math.log10(self.unknown)))
        together = F.log10(_discounted("n_pair", self.pair_discounts) / (F.col("n_context") + PSEUDO))
        term = F.coalesce(together, F.coalesce("log_alpha", F.lit(0.0)) + alone)
        known = pairs.join(self.counts.select("context", "word", F.col("n").alias("n_pair")), ["context", "word"], "left").join(words, "word", "left").join(self.backoff, "context", "left")
        sums = known.groupBy("a", "b").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * term).alias("score"))
        return keyed.select("doc_id", "a", "b").join(sums, ["a", "b"]).select("doc_id", "n_tokens", "score")


def fit_score(docs: DataFrame, held: Column | None = None, k: int = K, bucket_bytes: int = BUCKET_BYTES, parts: int = PARTS) -> Model:
    """Learns from the rows of docs where `held` is false (default: held_out(doc_id)) and scores all of them."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), (held_out(F.col("doc_id")) if held is None else held).alias("held"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).collect()[0][0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    frequent = _frequent(slim, buckets)
    done = common.cut(_pairs(slim, buckets, np.array(sorted(frequent), _U)).groupBy("bucket").applyInArrow(_count(frequent, k, parts), _OUT), "kind")
    common.release(docs.sparkSession)  # nothing refers to the packed pairs any more
    numbers = {(r["kind"], r["word"]): r["n"] for r in done.filter("kind in ('words', 'pairs')").groupBy("kind", "word").agg(F.sum("n").alias("n")).collect()}
    of = lambda kind: [numbers.get((kind, i)) or 0 for i in range(1, k + 4)]  # noqa: E731  counted 1..k+1 times, more often, sum
    words, pairs = of("words"), of("pairs")
    seen_hot = [c for c in frequent.values() if c]
    for c in seen_hot:
        words[min(c, k + 2) - 1] += 1
    total, vocabulary = words[-1] + sum(seen_hot), sum(words[:-1])
    d_word, d_pair = discounts(words[: k + 1]), discounts(pairs[: k + 1])
    left = sum((1 - d_word[r - 1]) * r * words[r - 1] for r in range(1, k + 1)) + PSEUDO if total else 1.0
    whole = total + PSEUDO if total else 1.0
    unknown = left / whole

    counts = done.filter("kind = 'counts'").select("context", "word", "n", "n_word")
    summed = counts.groupBy("context").agg(F.sum("n").alias("n_context"), F.sum(_discounted("n", d_pair)).alias("_d"), F.sum(_discounted("n_word", d_word)).alias("_p"))
    alpha = (1 - F.col("_d") / (F.col("n_context") + PSEUDO)) / (1 - F.col("_p") / whole)
    backoff = common.cut(summed.select("context", "n_context", F.log10(alpha).alias("log_alpha")))
    # unseen pairs: in place of -log10(n_context + PSEUDO), which every known context has left, log10 alpha
    weight = F.col("n") * (F.col("log_alpha") + F.log10(F.col("n_context") + PSEUDO))
    unseen = done.filter("kind = 'unseen'").select("context", "batch", "doc", "n").join(backoff, "context").groupBy("batch", "doc").agg(F.sum(weight).alias("unseen"))
    starts = slim.filter(~F.col("held")).count()
    start = -math.log10(starts + PSEUDO)
    logs = [math.log10(x) for x in (*d_pair, *d_word)]
    log_n, log_unknown, log_base = math.log10(whole), math.log10(unknown), math.log10(total + vocabulary + 1)
    id_kind = slim.schema["doc_id"].dataType.simpleString()

    # every token but the end is a context; its total and the base score's term are both log10(count + 1)
    end = math.log10(starts + 1)

    def add_up(table: pa.Table) -> pa.Table:
        """All buckets' sums for one batch."""
        rows = table.sort_by("order").to_pylist()
        described = pa.ipc.open_stream(next(r["ids"] for r in rows if r["ids"])).read_all()
        m, number = described.num_rows, rows[0]["batch"]
        ints, reals = np.zeros((_ints(k), m), np.int64), np.zeros((3, m))
        for r in rows:
            n = r["doc"]
            x = _unpack(r["blob"], np.int32)
            ints[:, x[:n]] += x[n:].reshape(_ints(k), n)
            reals[0, x[:n]] += np.frombuffer(r["base"][: 8 * n])
            reals[1:, x[:n]] += np.frombuffer(r["base"][8 * n :], np.float32).reshape(2, n)
        tokens = described.column("n_tokens").to_numpy()
        score = start - (reals[0] - end) + reals[1] + reals[2] + sum(x * n for x, n in zip(logs, ints[1 : 1 + 2 * k], strict=True)) - log_n * ints[1 + 2 * k] + log_unknown * ints[2 + 2 * k]
        return pa.table({"batch": pa.array([number] * m, pa.int64()), "doc": pa.array(range(m), pa.int32()), "doc_id": described.column("doc_id"), "held_out": described.column("held"), "n_tokens": pa.array(tokens), "n_known": pa.array(ints[0]), "base_score": pa.array(reals[0] - tokens * log_base), "seen": pa.array(score)})

    per_batch = done.filter("kind = 'docs'").select("batch", "doc", "blob", "base", "ids", F.xxhash64("blob", "base").alias("order"))
    each = per_batch.groupBy("batch").applyInArrow(add_up, f"batch long, doc int, doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, seen double")
    scores = each.join(unseen, ["batch", "doc"], "left").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", (F.col("seen") + F.coalesce("unseen", F.lit(0.0))).alias("score"))
    return Model(counts, backoff, scores, d_word, d_pair, int(total), int(vocabulary), unknown)


def _ints(k: int) -> int:
    return 1 + 2 * k + 2

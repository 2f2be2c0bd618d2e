r"""Operator 11: spelling variants grouped by merging an errata trie.

Words are counted within tasks first. The different words, sorted, are dealt to ranges of about `range_words`; a range is a piece of the words' trie.
Of a node that lies in several ranges each range counts its children, and the sums name its heavy child (the one with most words, the first of
equal ones; the end of a word counts as a child of one, which is heavy only where it is alone). So every word knows the nodes that it leaves by a light child:
at most log2 of the number of words. There its subtree is merged with the character skipped or replaced (p: the node's prefix, c: the light child, h: the heavy one,
s: the rest of the word):

- light with light: all words p c s of a node meet in p * s;
- light into heavy: p c s is looked up as p h s (replaced), p s (c skipped), p h c s (h skipped in the other word).

Where a skipped character stands in a run of equal ones, only the run's last counts, so a pair of one inserted, deleted or replaced code point coincides exactly
once. Coinciding terminals are grouped by their strings; a group p * s has at most one word per letter, a looked-up word
at most its one-edit neighbours, and members are told their number and their best mate, never all pairs. Forms are followed by doubling.

Result: word, n, n_near (its near words), form, form_n (the near word of largest n, the first of equal ones in code-point order, if that n is at least `ratio` times the word's; else
null), root (what following forms ends at; the word itself if it has none).

Defined results: a null or empty text has no words; a null doc_id is hashed as an empty one; repeated rows count each, with the same deletions; an empty table gives an empty table;
very long texts are read run by run; strings of over KEY_LETTERS letters meet by their 128-bit hash; extra columns are ignored.
"""

from __future__ import annotations

import math
import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a range of the trie.
RANGE_WORDS = 20_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 100_000
KEY_LETTERS = 64
_UPPER = {c: c + 32 for c in range(65, 91)}


def counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, one_in: int = 31) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, one in `one_in` (by document and run) without one of its code points."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        table = lambda: pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in common.slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{doc or ''}:".encode())
                found = runs.findall(text or "") if len(text or "") <= common.CHUNK_BYTES else (m[0] for m in runs.finditer(text))
                for word, n in Counter(found).items():
                    low = word.lower() if word.isascii() else word.translate(_UPPER)
                    h = zlib.crc32(low.encode(), start)
                    if h % one_in == 0:
                        at = h % len(low)
                        low = low[:at] + low[at + 1 :]
                        if len(low) < least_letters:
                            continue
                    held[low] += n
                if len(held) > HELD_WORDS:
                    yield table()
                    held.clear()
        yield table()

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A range's sorted different words, between the last word before it and the first one after it."""

    def __init__(self, words: list[str], before: str | None, after: str | None):
        self.words = words
        shared = lambda a, b: len(os.path.commonprefix((a, b)))
        self.lcp = np.array([0, *map(shared, words, words[1:])], np.int64)  # of a word and the one before it
        self.left = -1 if before is None else shared(before, words[0])
        self.right = -1 if after is None else shared(words[-1], after)

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[str, int, int]]:
        """The children of the node with the words lo to hi and a prefix of `depth` letters: letter ("": a word's end), and its words."""
        edges = [lo, *(lo + 1 + np.flatnonzero(self.lcp[lo + 1 : hi] == depth)).tolist(), hi]
        return [(self.words[a][depth : depth + 1], a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def inner(self) -> Iterator[tuple[int, int, int]]:
        """(lo, hi, depth) of the nodes with several children that lie in this range alone."""
        n, stack = len(self.words), []
        for i, depth in enumerate([*self.lcp[1:].tolist(), -1], 1):
            lo = i - 1
            while stack and stack[-1][0] > depth:
                deep, lo = stack.pop()
                if not (lo == 0 and deep <= self.left) and not (i == n and deep <= self.right):
                    yield lo, i, deep
            if not stack or stack[-1][0] < depth:
                stack.append((depth, lo))

    def shared(self) -> list[tuple[int, int, int]]:
        """The nodes that also lie in other ranges."""
        n, found = len(self.words), set()
        low = np.minimum.accumulate(self.lcp[1:])  # what the words up to i + 1 share
        for depth in range(self.left + 1):
            found.add((0, 1 + int(np.searchsorted(-low, -depth, "right")), depth))
        low = np.minimum.accumulate(self.lcp[:0:-1])
        for depth in range(self.right + 1):
            found.add((n - 1 - int(np.searchsorted(-low, -depth, "right")), n, depth))
        return sorted(found)


def _key(text: str) -> str:
    return text if len(text) <= KEY_LETTERS else ("#*" if "*" in text else "#") + xxhash.xxh3_128_hexdigest(text.encode())


def _trie(left: pa.Table, right: pa.Table) -> tuple[Trie, list[int], list[int], dict]:
    """A range's trie, its words' ids and counts, and the rows of its neighbours."""
    rows = left.sort_by("id")
    side = right.to_pylist()[0]
    return Trie(rows["word"].to_pylist(), side["before"], side["after"]), rows["id"].to_pylist(), rows["n"].to_pylist(), side


def _shares(left: pa.Table, right: pa.Table) -> pa.Table:
    """part, node, letter, n: this range's words below each child of the nodes that it shares."""
    trie, _, _, side = _trie(left, right)
    out = [(side["part"], _key(trie.words[lo][:depth]), letter, z - a) for lo, hi, depth in trie.shared() for letter, a, z in trie.children(lo, hi, depth)]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["part", "node", "letter", "n"])


def terminals(trie: Trie, heavy_of: dict[str, str], least_letters: int) -> Iterator[tuple[int, str]]:
    """(word number, key): where the words of light children stand in the merged subtrees. heavy_of: the heavy child of the shared nodes."""
    nodes = [(lo, hi, depth, heavy_of[_key(trie.words[lo][:depth])]) for lo, hi, depth in trie.shared()]
    for lo, hi, depth, given in (*nodes, *((*x, None) for x in trie.inner())):
        children, prefix = trie.children(lo, hi, depth), trie.words[lo][:depth]
        letters = [c for c in children if c[0]]
        heavy = max(letters, key=lambda c: c[2] - c[1])[0] if given is None else given
        several = given is not None or len(letters) > 2
        for letter, a, z in children:
            if letter == heavy:
                continue
            for i in range(a, z):
                word = trie.words[i]
                yield i, _key(f"{prefix}{heavy}{word[depth:]}")
                if letter:
                    rest = word[depth + 1 :]
                    yield i, _key(f"{prefix}{heavy}{rest}")
                    if several:
                        yield i, _key(f"{prefix}*{rest}")
                    if rest[:1] != letter and len(word) > least_letters:
                        yield i, _key(prefix + rest)


def _met(ranged: DataFrame, sides: DataFrame, least_letters: int) -> DataFrame:
    """key, id, n, own: every word under its own string, and under its terminals."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trie, ids, ns, side = _trie(left, right)
        keys, at = [_key(w) for w in trie.words], list(range(len(ids)))
        for i, key in terminals(trie, {x["node"]: x["heavy"] for x in side["nodes"] or ()}, least_letters):
            at.append(i)
            keys.append(key)
        at = np.array(at)
        return pa.table([pa.array(keys, pa.string()), pa.array(np.array(ids)[at]), pa.array(np.array(ns)[at]), pa.array(np.arange(len(at)) < len(ids))], names=["key", "id", "n", "own"])

    return ranged.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(run, "key string, id long, n long, own boolean")


def _near(met: DataFrame) -> DataFrame:
    """id, n_near, near_id, near_count: each word's number of near words and the best of them."""
    groups = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "id", "own"))).alias("m")).filter(F.size("m") > 1)
    word = F.expr("get(filter(m, x -> x.own), 0)")
    groups = groups.select("m", word.alias("w")).filter("w is not null or instr(key, '*') > 0")
    # a looked-up word is near to all others of its group, and they to it alone; without one, all are near to each other
    mate = F.expr("transform(m, x -> case when w is null or x.own then struct(x.id as id, size(m) - 1 as n, if(x.id = m[0].id, m[1], m[0]) as best) else struct(x.id as id, 1 as n, w as best) end)")
    each = groups.select(F.explode(mate).alias("x")).select("x.id", "x.n", F.struct("x.best.minus", "x.best.id").alias("best"))
    return each.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")).select("id", "n_near", F.col("best.id").alias("near_id"), (-F.col("best.minus")).alias("near_count"))


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, range_words: int = RANGE_WORDS) -> DataFrame:
    words = common.cut(counts(docs, least_letters).filter(F.col("n") >= least_count))
    size = words.agg(F.count("*").alias("words"), F.max("n").alias("most")).head()
    ranges = max(1, math.ceil(size["words"] / range_words))
    ranged = common.cut(words.repartitionByRange(ranges, "word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    dealt = ranged.withColumn("part", F.shiftright("id", 33))
    ends = dealt.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    order = Window.orderBy("part")  # a row per range
    sides = common.cut(ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")))
    shares = common.cut(dealt.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(_shares, "part long, node string, letter string, n long"))
    heavy = shares.groupBy("node", "letter").agg(F.sum("n").alias("n")).groupBy("node").agg(F.min(F.struct((F.col("letter") == "").alias("end"), (-F.col("n")).alias("n"), "letter")).alias("h"))
    nodes = shares.select("part", "node").distinct().join(heavy.select("node", F.col("h.letter").alias("heavy")), "node").groupBy("part").agg(F.collect_list(F.struct("node", "heavy")).alias("nodes"))
    near = _near(_met(dealt, sides.join(nodes, "part", "left"), least_letters))
    formed = common.cut(ranged.select("id", "n").join(near, "id", "left").withColumn("form_id", F.when(F.col("near_count") >= ratio * F.col("n"), F.col("near_id"))).select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_id"))
    steps = common.cut(formed.filter("form_id is not null").select("id", F.col("form_id").alias("root_id")))
    # a form has ratio times the count, so a chain has at most so many steps; each round doubles them
    longest = max(1.0, math.log(max((size["most"] or 1) / least_count, 1), max(ratio, 2)))
    for _ in range(math.ceil(math.log2(longest)) if ratio > 1 else 0):
        next_step = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("_next"))
        steps = common.cut(steps.join(next_step, "root_id", "left").select("id", F.coalesce("_next", "root_id").alias("root_id")))
    named = lambda column: ranged.select(F.col("id").alias(f"{column}_id"), F.col("word").alias(column))
    found = ranged.join(formed, "id").join(steps, "id", "left").join(ranged.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id", "left").join(named("root"), "root_id", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), cast(2 * i + 1 as bigint), 2))::bigint)), lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 as bigint)])), 4294967295)"

#: The same rows in DuckDB SQL.
ORACLE_SQL = f"""
with recursive bits as (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) as r(i)),
crc as (select list(v order by i) as t from bits),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as w from documents),
per_doc as (select doc_id, w, coalesce(cast(doc_id as varchar), '') || ':' || w as s, count(*) as n from runs where length(w) >= 7 group by doc_id, w),
hashed as (select w, n, {_CRC} as h from per_doc, crc),
typed as (select case when h % 31 = 0 then substr(w, 1, cast(h % length(w) as bigint)) || substr(w, cast(h % length(w) as bigint) + 2) else w end as word, n from hashed),
words as materialized (select word, cast(sum(n) as bigint) as n from typed where length(word) >= 7 group by word having sum(n) >= 2),
cut as materialized (select word, n, i, substr(word, 1, cast(i as bigint)) || substr(word, cast(i as bigint) + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (select a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
near as materialized (select word, count(*) as n_near, min((-near_n, near)) as best from pairs group by word),
formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best[1] >= 10 * w.n then best[2] end as form, case when -best[1] >= 10 * w.n then -best[1] end as form_n from words w left join near using (word)),
steps as (select word, word as root, form as next from formed union all select s.word, s.next, f.form from steps s join formed f on f.word = s.next)
select f.word, f.n, n_near, form, form_n, root from formed f join steps s on s.word = f.word and s.next is null
"""

"""Operator 2: n-gram Jaccard join by MinHash banding.

A document's n-grams are the `n` consecutive words of its lower-cased text ([0-9a-z] and non-ASCII bytes make words),
as a set; a text of fewer words, but not none, has one n-gram of all its words. Documents with the same set are
copies and count as one class from here on. Bands and rows are chosen for a target recall at the threshold;
class representatives are shuffled on their band hashes, and each bucket gives one edge per member
(to its least member), so buckets of any size stay linear. Every pair of a bucket lies in one group: a component of these
edges. A group's full n-gram sets meet, and every pair is verified exactly.

A group of more than `block` sets (or `block_grams` n-grams) is split. Around a pivot, the n-grams that most of its sets hold, sets are put in rings by
their exact Jaccard distance to it, which is a metric: sets close to it are all linked to each other and are counted by sums, without being
compared, and sets more than two rings apart, or of sizes whose ratio is under the threshold, can't be linked. The other pairs are compared block against
block. What leaves a block is a row per node and its component; what leaves a pair of blocks is a row per node with links, and edges between components. So a large
group of near copies of one text costs a row for each.

Results: class_id is the least doc_id of the documents connected by links; copy_id the least of the documents with the same
set; n_links counts the other documents whose Jaccard similarity is at least the threshold, copies included.

Defined results: null, empty or wordless texts have no set: they link to nothing and are their own class. Very long texts are taken whole, hashed in pieces; a set travels as 8 bytes per distinct n-gram.
Repeated rows, and rows of one doc_id with other texts, count as documents each. Null doc_ids are skipped when the least is taken; their links count. Extra columns are ignored by
`join` and kept by `deduplicated`. An empty table gives an empty table. Only a pair that shares no
band is missed: at most 1 - recall of those at the threshold, fewer above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 320
#: Sets, and n-grams of all its sets, that a task compares with each other or with as many others.
BLOCK = 500
BLOCK_GRAMS = 1 << 20
#: Sets of a large group from which its pivot is made, about. Any pivot gives the same results.
SAMPLE = 64
_MULT = np.uint64(0xA24BAED4963EE407)


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the fewest false candidates whose recall at the threshold is at least `recall`, of at most `most` hashes."""
    fitting = []
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 1 - recall else int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most:
            fitting.append((rows, bands))
    rows, bands = max(fitting)
    return bands, rows


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of some texts, one after the other and with repeats, and how many each text has."""
    h, counts = common.word_hashes(texts, common.LOWER_ALNUM)
    if not len(h):
        return h, counts
    own = np.repeat(np.arange(len(counts)), counts)
    rolled = h.copy()
    for k in range(1, n):
        rolled[: len(h) - k] = common.mix(rolled[: len(h) - k] * _MULT + h[k:])
    first = np.cumsum(counts) - counts
    place = np.arange(len(h)) - first[own]
    keep = place <= (counts - n)[own]
    for i in np.flatnonzero((counts > 0) & (counts < n)):  # short texts: all words make the one n-gram
        x = np.array([counts[i]], np.uint64)
        for w in h[first[i] : first[i] + counts[i]]:
            x = common.mix(x * _MULT + w)
        rolled[first[i]], keep[first[i]] = x[0], True
    return rolled[keep], np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))


def _node(grams: np.ndarray) -> bytes:
    """128-bit hash of a set, given sorted."""
    return np.array([common.mix(grams).sum(), common.mix(grams ^ _MULT).sum() + np.uint64(len(grams))], ">u8").tobytes()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, h, text) -> doc_id, h, node (128-bit hash of the set, null without words), grams (the set's size) and the set's band hashes."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most=1 << 20):
            grams, counts = shingles(batch.column("text").to_pylist(), n)
            some = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[some]
            nodes: list[bytes | None] = [None] * batch.num_rows
            sizes = np.zeros(batch.num_rows, np.int64)
            found: list[list[int] | None] = [None] * batch.num_rows
            if len(some):
                for i, a in zip(some, first, strict=True):
                    own = np.unique(grams[a : a + counts[i]])
                    nodes[i], sizes[i] = _node(own), len(own)
                least = np.empty((bands * rows, len(some)), np.uint64)
                scratch = np.empty_like(grams)
                for j, f in enumerate(factors):
                    np.multiply(grams, f, out=scratch)
                    np.minimum.reduceat(scratch, first, out=least[j])
                keys = np.zeros((bands, len(some)), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[:, None]
                for r in range(rows):
                    keys = common.mix(keys * _MULT + least[r::rows])
                for i, k in zip(some, keys.T.astype(np.int64), strict=True):
                    found[i] = k
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.binary()), pa.array(sizes), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "grams", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, h long, node binary, grams long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """docs(node, c, size, text) -> the same with the sorted set for the text; a node that comes again in a task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[bytes] = set()
        for batch in common.slices(batches, most=1 << 20):
            grams, counts = shingles(batch.column("text").to_pylist(), n)
            ends = np.cumsum(counts)
            rows, sets = [], []
            for i, (b, c, node) in enumerate(zip(ends, counts, batch.column("node").to_pylist(), strict=True)):
                if node not in before:
                    own = np.unique(grams[b - c : b])
                    if _node(own) == node:  # else another text with the same hash
                        before.add(node)
                        rows.append(i)
                        sets.append(own.tobytes())
            out = batch.select(["node", "c", "size"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary())], names=["node", "c", "size", "grams"])

    return docs.mapInArrow(run, "node binary, c binary, size long, grams binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """How many elements each left set shares with each right set."""
    every = np.concatenate([*left, *right])
    values, at, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    cols = np.where(counts[at] > 1, shared[at], -1)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    owner, cols = owner[cols >= 0], cols[cols >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(cols.max(initial=-1)) + 1, width):
        inside = (cols >= a) & (cols < a + width)
        grid = np.zeros((len(left) + len(right), width), np.float32)
        grid[owner[inside], cols[inside] - a] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)


def _near(left: list[np.ndarray], right: list[np.ndarray], threshold: float, tile: int = 200) -> np.ndarray:
    """Which left and right sets have at least the threshold's similarity."""
    out = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), tile):
        for j in range(0, len(right), tile):
            a, b = left[i : i + tile], right[j : j + tile]
            both = overlaps(a, b)
            out[i : i + tile, j : j + tile] = both >= threshold * (np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both) - 1e-9
    return out


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each vertex's component in a graph of n vertices."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([top(x) for x in range(n)], np.int64)


def _group_roots(near: np.ndarray) -> np.ndarray:
    """The same of a symmetric table of links, breadth first."""
    n = len(near)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] < 0:
            root[start], queue = start, [start]
            while queue:
                new = np.flatnonzero(near[queue.pop()] & (root < 0))
                root[new] = start
                queue += new.tolist()
    return root


_FOUND = "a binary, b binary, links long"


def _loaded(table: pa.Table) -> tuple[pa.Table, list[bytes], list[np.ndarray], np.ndarray]:
    """A group without repeated nodes: the table, its nodes, sets and sizes."""
    table = table.take(pa.array(np.unique(np.array(table.column("node").to_pylist(), object), return_index=True)[1]))
    return table, table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()], table.column("size").to_numpy()


def _inside(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One block: of each node its links in the block, and the edge to its component's first node there."""
        _, nodes, sets, size = _loaded(table)
        near = _near(sets, sets, threshold)
        np.fill_diagonal(near, False)
        root = _group_roots(near)
        return pa.table({"a": pa.array(nodes, pa.binary()), "b": pa.array([nodes[x] for x in root], pa.binary()), "links": pa.array(near @ size)})

    return run


def _across(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Two blocks: of each node with links to the other block their number, and edges that join components of the blocks."""
        table, nodes, sets, size = _loaded(table)
        block = table.column("block").to_numpy()
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        links, joined = np.zeros(len(nodes), np.int64), np.zeros((0, 2), np.int64)
        tops, of = np.unique(np.array([*table.column("top").to_pylist(), None], object)[:-1], return_inverse=True)
        if len(one) and len(two):
            near = _near([sets[x] for x in one], [sets[x] for x in two], threshold)
            links[one] += near @ size[two]
            links[two] += near.T @ size[one]
            i, j = np.nonzero(near)
            joined = np.unique(np.stack([of[one[i]], of[two[j]]], axis=1), axis=0)
        root = _roots(len(tops), joined)
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(tops)))
        return pa.table(
            {
                "a": pa.array([*(nodes[x] for x in some), *(tops[x] for x in moved)], pa.binary()),
                "b": pa.array([*([None] * len(some)), *(tops[root[x]] for x in moved)], pa.binary()),
                "links": pa.array(np.append(links[some], np.zeros(len(moved), np.int64))),
            }
        )

    return run


def _consensus(table: pa.Table) -> pa.Table:
    """The n-grams that most of a group's sampled sets hold: what the copies in it were made from."""
    grams, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]), return_counts=True)
    return pa.table({"_c": table.column("c")[:1], "pivot": pa.array([grams[2 * n > table.num_rows].tobytes()], pa.binary())})


def _ringed(paired: DataFrame, threshold: float) -> DataFrame:
    """paired(node, c, size, grams, pivot) -> node, c, size, grams, ring and span.

    Jaccard distance obeys the triangle inequality. With rings of half the distance that a link may have, around any set as pivot: any two sets of
    ring 0 are linked, and linked sets are at most two rings apart. span numbers the sets' sizes, so that sizes of linked sets are at most one span apart."""
    width = (1 - Fraction(str(threshold))) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "grams"):
            rings, spans = [], []
            for own, pivot in zip(batch.column("grams").to_pylist(), batch.column("pivot").to_pylist(), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(pivot, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                rings.append(max(0, -(-(union - both) * width.denominator // (union * width.numerator)) - 1))
                spans.append(int(math.log(len(a)) / (1e-9 - math.log(threshold))))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("node", "c", "size", "grams")), pa.array(rings, pa.int32()), pa.array(spans, pa.int32())], names=["node", "c", "size", "grams", "ring", "span"])

    return paired.mapInArrow(run, "node binary, c binary, size long, grams binary, ring int, span int")


def _large(full: DataFrame, large: DataFrame, threshold: float, block: int, block_grams: int) -> list[DataFrame]:
    """What the groups of candidates in large(c, pivot_node) give, as a, b, links: of more sets than a task should compare."""
    own = full.join(large, "c")
    some = own.filter(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("m") / SAMPLE))) == 0)
    pivots = some.select("c", "grams").groupBy("c").applyInArrow(_consensus, "_c binary, pivot binary")
    paired = own.join(pivots, F.col("c") == F.col("_c"), "left").select("node", "c", "size", "grams", F.coalesce("pivot", F.lit(b"")).alias("pivot"))
    ringed = common.cut(_ringed(paired, threshold))
    # ring 0: every two are linked, so sums of sizes count their links, and one edge each joins them
    core = ringed.filter("ring = 0").select("node", "c", "size").dropDuplicates(["node"])
    weight = core.groupBy("c").agg(F.sum("size").alias("w"), F.min("node").alias("top"))
    linked = core.join(weight, "c").select(F.col("node").alias("a"), F.col("top").alias("b"), (F.col("w") - F.col("size")).alias("links"))
    # other pairs: cells of (ring, span) in blocks; a block meets the blocks of its cell and of the cells that may hold links to it
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("grams")) / (8 * block_grams)))
    cells = common.cut(ringed.groupBy("c", "ring", "span").agg(parts.cast("int").alias("parts")))
    number = lambda ring, span, k: (ring.cast("long") * 4096 + span) * (1 << 32) + k
    blocks = F.transform(F.sequence(F.lit(0), F.col("o.parts") - 1), lambda k: number(F.col("o.ring"), F.col("o.span"), k))
    meets = (F.col("i.c") == F.col("o.c")) & (F.abs(F.col("i.ring") - F.col("o.ring")) <= 2) & (F.abs(F.col("i.span") - F.col("o.span")) <= 1) & (F.col("i.ring") + F.col("o.ring") > 0)
    partners = cells.alias("i").join(cells.alias("o"), meets).groupBy("i.c", "i.ring", "i.span", "i.parts").agg(F.flatten(F.collect_list(blocks)).alias("others"))
    dealt = ringed.join(partners, ["c", "ring", "span"]).withColumn("block", number(F.col("ring"), F.col("span"), F.pmod(F.xxhash64("node"), F.col("parts"))))
    inside = common.cut(dealt.filter("ring > 0").groupBy("c", "block").applyInArrow(_inside(threshold), _FOUND))
    tops = inside.select(F.col("a").alias("node"), F.col("b").alias("top")).unionByName(linked.select(F.col("a").alias("node"), F.col("b").alias("top")))
    met = dealt.join(tops, "node").withColumn("other", F.explode("others")).filter("block <> other")
    across = met.select("node", "c", "size", "grams", "top", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")).groupBy("c", "bi", "bj").applyInArrow(_across(threshold), _FOUND)
    return [linked, inside, common.cut(across)]


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per document: doc_id, class_id, copy_id, n_links."""
    bands, rows = bands_for(threshold, recall)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = common.cut(signatures(slim, n, bands, rows))
    # one row of each class stands for it: the least (doc_id, text hash), rows without a doc_id last
    first = F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    keyed = common.cut(signed.filter("node is not null").groupBy("node").agg(first.alias("row"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("grams").alias("grams")))
    members = keyed.select("node", F.explode("bands").alias("key"))
    lead = members.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    leads = common.cut(members.join(lead, "key").groupBy("node").agg(F.min("lead").alias("least"), F.collect_set("lead").alias("leads")))
    # a node's edge to its least lead, and its other leads' edges to that: few distinct ones, however many members a bucket has
    star = leads.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(leads.select(F.explode("leads").alias("a"), F.col("least").alias("b")).distinct())
    candidates = graph.components(star)
    placed = common.cut(candidates.withColumnRenamed("v", "node").join(keyed.select("node", "row", "size", "grams"), "node"))
    slim = slim.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    one = placed.select("node", "c", "size", F.col("row.doc_id").alias("doc_id"), F.col("row.h").alias("h"))
    # merged at every size: where Spark broadcasts few candidates, texts don't move, and disk would grow faster than the input once they do
    texts = one.hint("merge").join(slim, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    full = common.cut(_sets(texts.select("node", "c", "size", "text"), n))
    large = common.cut(placed.groupBy("c").agg(F.count("*").alias("m"), F.sum("grams").alias("g")).filter((F.col("m") > block) | (F.col("g") > block_grams)).select("c", "m"))
    parts = [common.cut(full.join(large.select("c"), "c", "left_anti").groupBy("c").applyInArrow(_inside(threshold), _FOUND))]
    if not large.isEmpty():
        parts += _large(full, large, threshold, block, block_grams)
    found = reduce(DataFrame.unionByName, parts)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = graph.components(found.filter("a <> b").select("a", "b"))
    inside = keyed.join(linked.withColumnRenamed("v", "node"), "node", "left").join(counts, "node", "left")
    inside = inside.select("node", F.col("row.doc_id").alias("copy_id"), F.coalesce("c", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    least = inside.groupBy("c").agg(F.min("copy_id").alias("class_id"))
    named = common.cut(inside.join(least, "c").select("node", "class_id", "copy_id", "n_links"))
    common.discard(leads, placed, full, keyed)
    return signed.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay: of each class the row with the least doc_id (none last), once.

    Rows are told apart by doc_id and text, so of a repeated doc_id each text follows its own class; of rows that differ in other columns only, the first by these stays. Texts without words are in no class."""
    h, row, stays = common.fresh(docs, "_h"), common.fresh(docs, "_row"), common.fresh(docs, "_stays")
    hashed = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    # as ids, which join() only orders and compares
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(h).alias("text"))
    least = join(hashed.select(who.alias("doc_id"), "text"), **params).select(F.col("class_id").alias(stays)).distinct()
    kept = hashed.join(least, F.col("doc_id").eqNullSafe(F.col(stays)["id"]) & (F.col(h) == F.col(stays)["text"]))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0)))
    return kept.withColumn(row, once).filter(F.col(row) == 1).select(*docs.columns)


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents
),
g as (
  select distinct doc_id, array_to_string(w[a : a + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as a from d where len(w) >= 5)
  union all
  select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4
),
z as (select doc_id, count(*) as n from g group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from g as x join g as y on x.s = y.s and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
link as (select a, b, c = za.n and c = zb.n as same from common join z as za on za.doc_id = a join z as zb on zb.doc_id = b where c >= 0.8 * (za.n + zb.n - c)),
reach as (select doc_id, doc_id as other from d union select reach.doc_id, link.b from reach join link on link.a = reach.other),
class as (select doc_id, min(other) as class_id from reach group by doc_id)
select d.doc_id, class_id, least(d.doc_id, coalesce((select min(b) from link where link.a = d.doc_id and same), d.doc_id)) as copy_id,
       (select count(*) from link where link.a = d.doc_id) as n_links
from d join class on class.doc_id = d.doc_id
"""

"""Operator 8: line deduplication by overlapping windows of three lines.

All of it is DataFrame functions. A text is split at each \\n; every `window` consecutive lines make
a window, hashed to 128 bits; a window's first occurrence is the one with the least (doc_id, hash of
the text, position), and every line inside any later occurrence is removed; overlapping windows
merge. What is removed is judged on the input. Hashes and positions are shuffled, then the
removed positions meet the texts.

Defined results: null and empty texts, and texts of fewer than `window` lines, keep everything.
Windows without a word (of bytes other than 0x20 and 0x09-0x0D) are not compared; lines are compared as they
are. Of equal rows (same doc_id and text) the first is judged against the other documents, and the
further ones lose every window. A null doc_id sorts first. An empty table gives an empty
table. Columns other than doc_id and text are ignored. Very long texts are taken whole; their windows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 3
#: Equal rows that are written out from one row.
PORTION = 10_000
_WORD = r"[^\x20\x09-\x0D]"


def _starts(lines: str | Column, window: int) -> Column:
    """Positions of a text's windows that hold a word."""
    every = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.regexp_like(F.concat(*[F.get(lines, i + k) for k in range(window)]), F.lit(_WORD)))


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _h (hash of the text), p (first line) and a, b (the window's hash)."""
    lines = docs.select("doc_id", "_h", F.split("text", "\n").alias("_l"))
    at = lambda i: [F.get("_l", i + k) for k in range(window)]
    hashed = F.transform(_starts("_l", window), lambda i: F.struct(i.alias("p"), F.xxhash64(*at(i)).alias("a"), F.xxhash64(F.lit("b"), *at(i)).alias("b")))
    return lines.select("doc_id", "_h", F.explode(hashed).alias("w")).select("doc_id", "_h", "w.*")


def dedupe(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_spans (maximal runs of removed lines) and the kept text."""
    keyed = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("_h", F.xxhash64("text"))
    found = common.cut(windows(keyed, window))
    place = F.struct("doc_id", "_h", "p")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    none = F.array().cast("array<int>")
    gone = later.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.array_sort(F.collect_set("p")).alias("_p"))
    # how often equal rows stand is counted by keys; the texts move once, to meet what goes from them
    times = keyed.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.count("*").alias("_n")).filter("_n > 1")
    about = gone.withColumn("_n", F.lit(None).cast("long")).unionByName(times.withColumn("_p", F.lit(None).cast("array<int>"))).groupBy("_d", "_g").agg(F.first("_p", True).alias("_p"), F.max("_n").alias("_n"))
    about = common.cut(about).hint("merge")  # it grows with the corpus; small ones shouldn't take another way
    joined = keyed.join(about, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left").select("doc_id", "_h", "text", F.coalesce("_p", none).alias("_p"), "_n")
    once = joined.filter("_n is null").select("doc_id", "text", "_p")
    # equal rows become one before they are shuffled, and as many again after it: the first, and the others in portions
    equal = joined.filter("_n is not null").groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.first("_p").alias("_p"), F.max("_n").alias("_n"))
    further = equal.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - 1, F.lit(PORTION).cast("long"))).alias("_from"), "_n").repartition("_from", "doc_id")
    further = further.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(PORTION), F.col("_n") - F.col("_from")).cast("int"))).alias("_k")).select("doc_id", "text", _starts(F.split("text", "\n"), window).alias("_p"))
    known = once.unionByName(equal.select("doc_id", "text", "_p")).unionByName(further).withColumn("_l", F.split("text", "\n"))
    far = lambda a, b: (b - a) > window
    runs = known.select(
        "doc_id",
        "text",
        "_l",
        F.filter("_p", lambda x, j: (j == 0) | far(F.get("_p", j - 1), x)).alias("_from"),
        F.transform(F.filter("_p", lambda x, j: (j == F.size("_p") - 1) | far(x, F.get("_p", j + 1))), lambda x: x + window).alias("_to"),
    )
    n = F.size("_from")
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.slice("_l", F.coalesce(F.get("_to", k - 1), F.lit(0)) + 1, F.coalesce(F.get("_from", k), F.size("_l")) - F.coalesce(F.get("_to", k - 1), F.lit(0))),
    )
    removed = F.aggregate(F.zip_with("_to", "_from", lambda b, a: b - a), F.lit(0), lambda s, x: s + x)
    return runs.select("doc_id", F.size("_l").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), n.cast("long").alias("n_spans"), F.when(n == 0, F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n")).alias("text"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
w as (
  select doc_id, text, i as p, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as t
  from (select *, unnest(range(1, len(l) - 1)) as i from d)
),
named as (select * from w where regexp_matches(t, '[^\x20\x09-\x0D]')),
later as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by t order by doc_id, p) as k from named) where k > 1
),
hit as (select distinct doc_id, p + j as n from later, (values (0), (1), (2)) as o(j)),
lines as (select doc_id, i as n, l[i] as line from (select *, unnest(range(1, len(l) + 1)) as i from d)),
marked as (
  select lines.doc_id, lines.n, line, hit.n is not null as gone,
         lag(hit.n is not null, 1, false) over (partition by lines.doc_id order by lines.n) as before
  from lines left join hit on hit.doc_id = lines.doc_id and hit.n = lines.n
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_removed,
       cast(count(*) filter (where gone and not before) as bigint) as n_spans,
       coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '') as text
from marked group by doc_id
"""

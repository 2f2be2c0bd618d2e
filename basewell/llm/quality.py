"""Operator 9: quality rules whose thresholds adapt to each language and source.

All of it is DataFrame functions. Counts are taken from whole texts; the thresholds come from
quantile summaries (Greenwald-Khanna, which partial aggregates merge) of the ratios of every document
that the base rule passes, by (lang, source) and by lang; a document is held against its own group's
fences. A fence lies beyond the group's 95th percentile, by a part of its distance from the median and a
part of the median, so it has no constant in it: where a mark is usual much of it passes, where it is rare
little does.

Defined results: a null or empty text has no words and fails the base rule. Null languages or
sources form groups of their own. Equal rows get equal rows, and a ratio that equals its fence passes. A
group of fewer than `min_group` documents that pass the base rule uses its language's fences. Very long texts are taken whole. Other columns, whatever their names, are kept by
`filtered` and left out by `assess`. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5

#: Ratio -> (side, count, least). A document fails above the high fence where the count behind the ratio is at least `least`, or below the low
#: one. The counts let a few marks or one repeated line of a short text pass where a group has none.
RULES = {
    "symbol_ratio": ("high", "n_symbols", 20),
    "dup_line_ratio": ("high", "n_dup_lines", 3),
    "repeat_ratio": ("high", "n_repeat_words", 40),
    "mean_word": ("both", "n_words", 1),
}
LOW, MIDDLE, HIGH = 0.05, 0.5, 0.95
#: High fence: high + REACH * (high - middle) + MARGIN * middle, of the group's quantiles; the low one is its mirror image.
REACH = 0.5
MARGIN = 0.25
MIN_GROUP = 30
ACCURACY = 10000


def counts(text: Column, docs: DataFrame) -> DataFrame:
    """docs(_id, lang, source) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    base = docs.withColumn("_t", text).select(
        "*",
        F.array_remove(F.split("_t", WS + "+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias("_l"),
    )
    n = F.size("_w")
    hashed = base.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", WORD + "+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # windows found twice are looked for only where a window is found twice: sort them, keep equal neighbours
    ranked = hashed.select(
        *[c for c in hashed.columns if c != "_h"],
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("_s"),
    )
    twice = ranked.select(
        *[c for c in ranked.columns if c != "_s"],
        F.sort_array(F.transform(F.filter("_s", lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"])), lambda x: x["p"])).alias("_p"),
    )
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")))["sum"]
    return twice.select(*[c for c in twice.columns if c != "_p"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the ratios, cut from the text."""
    slim = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), common.text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = counts(F.col("text"), slim).drop("text")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return common.cut(
        found.select(
            "*",
            ((c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))).alias("base_failed"),
            per(c("n_symbols"), c("word_chars")).alias("symbol_ratio"),
            per(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
            per(c("n_repeat_words"), c("n_words")).alias("repeat_ratio"),
            per(c("word_chars"), c("n_words")).alias("mean_word"),
        )
    )


def fences(measured: DataFrame, reach: float = REACH, accuracy: int = ACCURACY) -> DataFrame:
    """By (lang, source) and, where `whole` is true, by lang: n, the documents that the base rule passes, and the low and high fence of each ratio among them."""
    quantiles = [F.expr(f"approx_percentile({m}, array({LOW}D, {MIDDLE}D, {HIGH}D), {accuracy})").alias(m) for m in RULES]
    passing = measured.filter(~F.col("base_failed"))
    own = passing.groupBy("lang", "source").agg(F.count("*").alias("n"), *quantiles).withColumn("whole", F.lit(False))
    lang = passing.groupBy("lang").agg(F.count("*").alias("n"), *quantiles).withColumns({"source": F.lit(None).cast("string"), "whole": F.lit(True)})
    both = own.unionByName(lang)
    out = ["lang", "source", "whole", "n"]
    for m, (side, _, _) in RULES.items():
        low, middle, high = (F.col(m)[i] for i in range(3))
        out += [(high + reach * (high - middle) + MARGIN * middle).alias(f"{m}_high"), ((low - reach * (middle - low) - MARGIN * middle) if side == "both" else F.lit(float("-inf"))).alias(f"{m}_low")]
    return both.select(*out)


def _judged(docs: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP, accuracy: int = ACCURACY) -> DataFrame:
    """Per row: doc_id, lang, source, the text's hash, base counts, base_failed, kept and the names of the rules that it breaks."""
    measured = measure(docs)
    table = fences(measured, reach, accuracy)
    limits = [f"{m}_{e}" for m in RULES for e in ("high", "low")]
    as_own = table.filter((~F.col("whole")) & (F.col("n") >= min_group)).select(F.col("lang").alias("_ol"), F.col("source").alias("_os"), F.lit(True).alias("_own"), *[F.col(x).alias(f"o_{x}") for x in limits])
    as_lang = table.filter("whole").select(F.col("lang").alias("_ll"), *[F.col(x).alias(f"l_{x}") for x in limits])
    joined = measured.join(as_own, F.col("lang").eqNullSafe(F.col("_ol")) & F.col("source").eqNullSafe(F.col("_os")), "left").join(as_lang, F.col("lang").eqNullSafe(F.col("_ll")), "left")
    limit = lambda x: F.when(F.col("_own"), F.col(f"o_{x}")).otherwise(F.col(f"l_{x}"))
    broken = F.array_compact(F.array(*[F.when(((F.col(m) > limit(f"{m}_high")) & (F.col(n) >= least)) | (F.col(m) < limit(f"{m}_low")), F.lit(m)) for m, (_, n, least) in RULES.items()]))
    return joined.withColumn("broken", broken).select(
        "doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), F.array_join("broken", ",").alias("broken")
    )


def assess(docs: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP, accuracy: int = ACCURACY) -> DataFrame:
    """Per document: doc_id, base counts, base_failed, kept and the names of the rules that it breaks."""
    return _judged(docs, reach, min_group, accuracy).drop("text_hash")


def filtered(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each row follows its own verdict: it is found again by doc_id, lang, source and
    the hash of its text, on which the verdict rests."""
    names = {c: common.fresh(docs, f"_{c}") for c in ("doc_id", "lang", "source", "text_hash")}
    bad = _judged(docs, **params).filter(~F.col("kept")).select(*[F.col(c).alias(x) for c, x in names.items()]).distinct()
    own = {"doc_id": F.col("doc_id"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "text_hash": F.xxhash64(common.text_or_empty())}
    return docs.join(bad, reduce(Column.__and__, [own[c].eqNullSafe(F.col(x)) for c, x in names.items()]), "left_anti")


def oracle_sql() -> str:
    """The query in SQL with exact quantiles, which the summaries give too in groups of up to ACCURACY / 2 documents."""
    names, levels = list(RULES), {"low": LOW, "mid": MIDDLE, "high": HIGH}
    quantile = lambda m, q: f"max(case when r_{m} = greatest(1, cast(ceil({q}::double * n) as bigint)) then {m} end)"
    ranks = lambda by: ", ".join(f"row_number() over (partition by {by} order by {m}) as r_{m}" for m in names)
    quantiles = ", ".join(f"{quantile(m, q)} as {m}_{k}" for m in names for k, q in levels.items())
    pick = ", ".join(f"case when own.n >= {MIN_GROUP} then own.{m}_{k} else whole.{m}_{k} end as {m}_{k}" for m in names for k in levels)
    high = lambda m: f"{m}_high + {REACH}::double * ({m}_high - {m}_mid) + {MARGIN}::double * {m}_mid"
    low = lambda m: f"{m}_low - {REACH}::double * ({m}_mid - {m}_low) - {MARGIN}::double * {m}_mid"
    broken = ", ".join(f"case when ({m} > {high(m)} and {n} >= {least})" + (f" or {m} < {low(m)}" if side == "both" else "") + f" then '{m}' end" for m, (side, n, least) in RULES.items())
    group = lambda name, by: f"{name}_r as (select *, count(*) over (partition by {by}) as n, {ranks(by)} from m where not base_failed), {name} as (select {by}, max(n) as n, {quantiles} from {name}_r group by {by})"
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select doc_id, a, array_to_string(w[a : a + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as a from w where len(w) >= 5)),
often as (select doc_id, s from win group by doc_id, s having count(*) > 1),
rep as (select doc_id, count(*) as c from (select distinct win.doc_id, unnest(range(a, a + 5)) as p from win join often on often.doc_id = win.doc_id and often.s = win.s) group by doc_id),
c as (
  select w.doc_id, lang, source, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.c, 0) as n_repeat_words
  from w left join rep on rep.doc_id = w.doc_id
),
m as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, case when word_chars > 0 then n_symbols / word_chars else 0.0::double end as symbol_ratio,
         case when n_lines > 0 then n_dup_lines / n_lines else 0.0::double end as dup_line_ratio, case when n_words > 0 then n_repeat_words / n_words else 0.0::double end as repeat_ratio,
         case when n_words > 0 then word_chars / n_words else 0.0::double end as mean_word
  from c
),
{group("own", "lang, source")},
{group("whole", "lang")},
f as (select m.*, {pick} from m left join own on own.lang is not distinct from m.lang and own.source is not distinct from m.source left join whole on whole.lang is not distinct from m.lang),
b as (select *, list_filter([{broken}], lambda x: x is not null) as x from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(x) = 0 as kept, array_to_string(x, ',') as broken from b
"""

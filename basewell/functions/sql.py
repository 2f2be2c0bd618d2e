"""DNA words and lookups as SQL functions of the session, written in SQL, so Spark plans through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .params import IndexParams

_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_NUMBER = "cast(conv(translate({}, 'ACGT', '0123'), 4, 10) as bigint)"

#: Name -> (parameters, type, body).
_FUNCTIONS = {
    "dna_encode": ("word string", "bigint", _NUMBER.format("word")),
    "dna_decode": ("number bigint, bases int", "string", "translate(lpad(conv(cast(number as string), 10, 4), bases, '0'), '0123', 'ACGT')"),
    "dna_revcomp": ("word string", "string", _RC.format("word")),
    "dna_canonical": ("word string", "string", f"least(word, {_RC.format('word')})"),
    "dna_core": ("word string, bases int", "string", "substring(word, cast((length(word) - bases) / 2 as int) + 1, bases)"),
    "dna_flanks": ("word string, bases int", "string", "concat(substring(word, 1, cast((length(word) - bases) / 2 as int)), substring(word, cast((length(word) - bases) / 2 as int) + bases + 1))"),
    "dna_hamming": ("a bigint, b bigint", "int", "cast(bit_count(((a ^ b) | shiftrightunsigned(a ^ b, 1)) & 1431655765) as int)"),
    "pack_position": ("ref_id bigint, pos bigint", "bigint", "shiftleft(ref_id & 268435455, 34) | (pos & 17179869183)"),
    "unpack_position": ("packed bigint", "struct<ref_id: bigint, pos: bigint>", "named_struct('ref_id', shiftrightunsigned(packed, 34) & 268435455, 'pos', packed & 17179869183)"),
}


def _occurrences(p: IndexParams) -> str:
    """Windows, one step of names after the other; arrays of one row stand for let."""
    half, k, c = p.f // 2, p.k, p.c
    fl = "concat(substring(w, 1, {0}), substring(w, {1}, {0}))".format(half, half + c + 1)
    words = f"filter(transform(sequence(0, length(seq) - {k}), i -> named_struct('pos', cast(i as bigint), 'w', substring(seq, i + 1, {k}))), x -> translate(x.w, 'ACGT', '') = '')"
    if p.orient == "kmer":
        words = f"transform({words}, x -> named_struct('pos', x.pos, 'w', least(x.w, {_RC.format('x.w')})))"
        core, flank = f"substring(x.w, {half + 1}, {c})", fl.replace("(w,", "(x.w,")
        taken = f"transform({words}, x -> named_struct('pos', x.pos, 'core', {core}, 'flank', {flank}))"
    else:
        a, flank = f"substring(x.w, {half + 1}, {c})", fl.replace("(w,", "(x.w,")
        taken = f"transform({words}, x -> named_struct('pos', x.pos, 'core', least({a}, {_RC.format(a)}), 'flank', if({a} < {_RC.format(a)}, {flank}, {_RC.format(flank)})))"
    if p.s and p.s < c:
        smers = [f"substring(x.core, {i + 1}, {p.s})" for i in range(c - p.s + 1)]
        taken = f"filter({taken}, x -> least({', '.join(smers)}) in ({smers[0]}, {smers[-1]}))"
    number = _NUMBER.format("x.flank") if p.f else "0L"
    return f"if(length(seq) >= {k}, transform({taken}, x -> named_struct('pos', x.pos, 'key', {_NUMBER.format('x.core')}, 'flank', {number})), array())"


def register(spark: SparkSession, p: IndexParams) -> None:
    """Makes dna_encode, dna_decode, dna_revcomp, dna_canonical, dna_core, dna_flanks, dna_hamming, pack_position and unpack_position functions of the session, and
    kmer_occurrences(seq): array of (pos, key, flank) of a sequence's windows under p. Null, or no windows, gives an empty array. For sequences or chunks that fit a row; to explode it, select it in a subquery first."""
    all_of = _FUNCTIONS | {"kmer_occurrences": ("seq string", "array<struct<pos: bigint, key: bigint, flank: bigint>>", _occurrences(p))}
    for name, (given, kind, body) in all_of.items():
        spark.sql(f"create or replace temporary function {name}({given}) returns {kind} return {body}")


def attach(index: DataFrame, p: IndexParams, refs: DataFrame | None = None) -> None:
    """Makes an index the view kmer_index (and its dictionary kmer_refs) of its session, with the functions of `register` and the table functions

    lookup(word): the rows of a core; all_matches(k): occurrences of a key, for lateral joins with tables of keys; best_flex_match(): nearest occurrences of the
    windows in the view kmer_queries(query_id, qpos, key, flank), which the user makes. They are aggregated before they are shuffled and joined back, without a window."""
    spark = index.sparkSession
    register(spark, p)
    index.createOrReplaceTempView("kmer_index")
    if refs is not None:
        refs.createOrReplaceTempView("kmer_refs")
    hamming = _FUNCTIONS["dna_hamming"][2].replace("(a ^ b", "(q ^ f")
    number = _NUMBER.format(f"least(word, {_RC.format('word')})")
    spark.sql(f"create or replace temporary function lookup(word string) returns table(key bigint, n bigint, ref_id bigint, pos bigint, flank bigint) return select key, n, ref_id, pos, flank from kmer_index where key = {number}")
    spark.sql("create or replace temporary function all_matches(k bigint) returns table(ref_id bigint, rpos bigint, flank bigint) return select ref_id, pos, flank from kmer_index where key = k")
    spark.createDataFrame([], "query_id long, qpos long, key long, flank long").createOrReplaceTempView("kmer_queries")
    spark.sql(f"""create or replace temporary function best_flex_match() returns table(query_id bigint, qpos bigint, key bigint, ref_id bigint, rpos bigint, dist int, ties bigint) return
with pairs as (
  select key, q, f, m, cast({hamming.removeprefix("cast(").removesuffix(" as int)")} as int) as dist
  from (select distinct key, flank as q from kmer_queries) join (select key, flank as f, count(*) as m from kmer_index where flank is not null group by key, flank) using (key)
),
near as (select key, q, min(struct(dist, ties)) as b from (select key, q, dist, sum(m) as ties from pairs group by key, q, dist) group by key, q)
select a.query_id, a.qpos, a.key, x.ref_id, x.pos, cast(null as int), cast(null as bigint) from kmer_queries a join kmer_index x on x.key = a.key where x.flank is null
union all
select a.query_id, a.qpos, a.key, x.ref_id, x.pos, near.b.dist, near.b.ties
from kmer_queries a join near on near.key = a.key and near.q = a.flank join pairs on pairs.key = near.key and pairs.q = near.q and pairs.dist = near.b.dist join kmer_index x on x.key = pairs.key and x.flank = pairs.f""")

import pytest
from pyspark.sql import functions as F

from basewell.functions import dna
from basewell.functions.params import IndexParams
from basewell.operators import display, match, windows
from basewell.operators import index as ix
from basewell.plans.build import build_index
from basewell.sources import fasta, store
from basewell.streaming import lookups

DEMO = "CATCGATCGTACGTGACTGCGTCGTCCTGCGTCGTCGTCGTGCTGCTGCTGTCGTCGTCGTCGTGCTGTCGTCGTA"
P = IndexParams(c=3, f=8, cells_per_body=8, max_range_size=1000)
#: core -> (n, first cell, cell after the last)
GOLDEN = {"ACA": (2, 0, 2), "ACG": (14, 2, 23), "ACT": (1, 23, 24), "AGC": (4, 24, 30), "AGG": (1, 30, 31), "ATC": (2, 31, 33), "CAC": (3, 33, 38), "CAG": (6, 38, 47), "CGA": (10, 47, 62), "CGC": (2, 62, 64), "GAC": (11, 64, 81), "GCA": (6, 81, 90), "GGA": (1, 90, 91), "GTA": (2, 91, 93), "TCA": (1, 93, 94)}


@pytest.fixture(scope="module")
def demo(spark):
    return build_index(fasta.literal(spark, DEMO), P)


def as_word(df, n=3):
    return df.withColumn("core", dna.decode("key", n))


def test_spectra(spark):
    found = windows.spectrum(fasta.literal(spark, DEMO), 3).groupBy("key").count()
    assert {r["core"]: r["count"] for r in as_word(found).collect()} == {"ACA": 2, "ACG": 15, "ACT": 1, "AGC": 4, "AGG": 1, "ATC": 3, "ATG": 1, "CAC": 3, "CAG": 6, "CGA": 13, "CGC": 2, "GAC": 12, "GCA": 6, "GGA": 1, "GTA": 3, "TCA": 1}
    long = windows.spectrum(fasta.literal(spark, DEMO), 10).groupBy("key").count().groupBy("count").agg(F.count("*").alias("m"))
    assert {r["count"]: r["m"] for r in long.collect()} == {1: 43, 2: 9, 3: 2}


def test_layout(demo):
    rows = as_word(ix.ranges(demo.keys, P)).collect()
    assert {r["core"]: (r["n"], r["v_start"], r["v_end"]) for r in rows} == GOLDEN
    assert all(r["has_flank"] == (r["n"] > 2) for r in rows)
    cells = {r["key"]: (r["block_cell"], r["key_cell"]) for r in rows}
    assert cells[7] == (0, 11)
    s = demo.stats.head()
    assert (s["kmers"], s["sampled"], s["rate"], s["distinct_keys"], s["skipped_keys"], s["value_cells"], s["refs"]) == (66, 66, 1.0, 15, 0, 94, 1)


def test_values(demo):
    rows = match.lookup_word(demo.index, "CGT").orderBy("pos").collect()  # made canonical: ACG
    assert [(r["pos"], r["flank"]) for r in rows] == [(3, 6966), (6, 56289), (7, 11718), (15, 34379), (18, 18969), (25, 34378), (28, 34329), (31, 17944), (34, 18712), (48, 34322), (51, 34328), (54, 17944), (57, 18712), (65, 50706)]
    assert [(r["pos"], r["flank"]) for r in match.lookup_word(demo.index, "GTA").orderBy("pos").collect()] == [(4, None), (5, None)]
    assert match.lookup_word(demo.index, "AAA").count() == 0
    slots = {(r["key"], r["pos"]): r["slot"] for r in ix.slots(demo.index).collect()}
    assert slots[6, 3] == 0 and slots[6, 65] == 13


def test_whole_window_orientation(spark):
    p = IndexParams(c=3, f=8, cells_per_body=8, orient="kmer")
    made = build_index(fasta.literal(spark, DEMO), p)
    assert made.keys.count() == 22 and made.stats.head()["value_cells"] == 92
    assert [r["pos"] for r in match.lookup(made.index, 6).orderBy("pos").collect()] == [3, 7, 18, 28, 31, 34, 51, 54, 57]
    first = [r for r in display.shown(made.index).collect() if r["key"] == 6][0]
    assert first["text"].split("\n")[0] == "AAAAAAAAACGTATCG: 17179869187" and first["detail"].split("\n")[0] == "AAAAAAAAACGTATCG: 1 3"


@pytest.mark.parametrize(("flank", "dist", "positions"), [("GACGACGA", 0, [51]), ("CACGACGA", 0, [31, 54]), ("CAGGACGA", 1, [18, 31, 34, 54, 57]), ("AAAAACGT", 4, [18, 28, 31, 34, 51, 54, 57])])
def test_best_match(spark, demo, flank, dist, positions):
    asked = spark.createDataFrame([(1, 0, 6, int(flank.translate(str.maketrans("ACGT", "0123")), 4))], "query_id long, qpos long, key long, flank long")
    rows = match.best_flex_match(asked, demo.index).orderBy("rpos").collect()
    assert [(r["rpos"], r["dist"], r["ties"]) for r in rows] == [(p, dist, len(positions)) for p in positions]
    same = lookups.best_matches(asked, ix.nested(demo.index)).orderBy("rpos").collect()
    assert [(r["rpos"], r["dist"], r["ties"]) for r in same] == [(p, dist, len(positions)) for p in positions]


def test_match_edges(spark, demo):
    asked = spark.createDataFrame([(1, 0, 44, 0), (1, 1, 0, 0)], "query_id long, qpos long, key long, flank long")
    assert sorted((r["rpos"], r["dist"], r["ties"]) for r in match.best_flex_match(asked, demo.index).collect()) == [(4, None, None), (5, None, None)]
    assert [r["key"] for r in match.misses(asked, demo.index).collect()] == [0]
    every = {(r["query_id"], r["qpos"], r["rpos"]) for r in match.all_matches(asked, demo.index).collect()}
    assert every >= {(r["query_id"], r["qpos"], r["rpos"]) for r in match.best_flex_match(asked, demo.index).collect()}
    asked = match.queries_of(fasta.literal(spark, DEMO[:20]), P)
    ranked = match.rarest_first(asked, demo.keys).orderBy("rank").collect()
    assert [r["n"] for r in ranked] == sorted(r["n"] for r in ranked)
    assert {r["name"] for r in match.with_names(match.all_matches(asked, demo.index), demo.refs).collect()} == {"seq1"}


def test_stream(spark, demo, tmp_path):
    asked = spark.createDataFrame([(1, 0, 6, 18968)], "query_id long, qpos long, key long, flank long")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    nested = store.written(ix.nested(demo.index))
    q = lookups.best_matches(stream, nested).writeStream.format("memory").queryName("answers").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["rpos"] for r in spark.table("answers").collect()) == sorted(r["rpos"] for r in match.best_flex_match(asked, demo.index).collect())


def test_caps(spark):
    seqs = fasta.literal(spark, DEMO)
    for cap, there in ((14, True), (13, False)):
        made = build_index(seqs, IndexParams(c=3, f=8, cells_per_body=8, max_range_size=cap))
        assert (match.lookup(made.index, 6).count() > 0) == there
        assert made.stats.head()["skipped_keys"] == (0 if there else 1)


def test_hash_layout(spark):
    index = spark.createDataFrame([(n, n, 1, i, None) for n in range(1, 10) for i in range(n)], "key long, n long, ref_id long, pos long, flank long")
    kept = {r["key"]: r["count"] for r in ix.truncated(index, IndexParams(c=3, f=8, cells_per_body=8)).groupBy("key").count().collect()}
    assert [kept[n] for n in range(1, 10)] == [1, 2, 2, 2, 3, 4, 4, 5, 6]


def test_even_core_tie(spark):
    p = IndexParams(c=4, f=2, cells_per_body=8)
    r = windows.occurrences(fasta.literal(spark, "AACGTC"), p).head()
    assert (r["key"], r["flank"]) == (27, 11)  # ACGT; the reverse strand's flanks GT


def test_strands_and_bounds(spark):
    p = IndexParams(c=5, f=4, s=3, cells_per_body=8)
    text = (DEMO * 9)[:600] + "N" + DEMO + "nACGT" + DEMO[::-1] * 4
    rc = text.upper()[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    a, b = (build_index(fasta.from_dataframe(fasta.literal(spark, t), "ref_id", "seq"), p) for t in (text, rc))
    assert sorted(map(tuple, a.keys.collect())) == sorted(map(tuple, b.keys.collect()))
    up, expected = text.upper(), []
    for i in range(len(up) - 8):
        w = up[i : i + 9]
        if "N" in w:
            continue
        f, r = w[2:7], w[2:7][::-1].translate(str.maketrans("ACGT", "TGCA"))
        core = min(f, r)
        smers = [core[j : j + 3] for j in range(3)]
        if min(smers) in (smers[0], smers[-1]):
            expected.append(i)
    assert [x["pos"] for x in windows.occurrences(fasta.from_dataframe(fasta.literal(spark, text), "ref_id", "seq"), p).orderBy("pos").collect()] == expected


def test_empty(spark):
    none = spark.createDataFrame([], "ref_id long, name string, seq string")
    made = build_index(none, P)
    s = made.stats.head()
    assert made.index.count() == 0 and (s["kmers"], s["rate"], s["value_cells"], s["refs"]) == (0, None, 0, 0)
    assert windows.occurrences(fasta.literal(spark, "ACGT"), P).count() == 0


def test_store(spark, demo, tmp_path):
    demo.save(str(tmp_path / "ix"))
    index, keys, refs, p = store.load(spark, str(tmp_path / "ix"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, index.collect()), key=key) == sorted(map(tuple, demo.index.collect()), key=key)
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, demo.keys.collect())) and refs.count() == 1 and p == P
    spark.createDataFrame([(2, "{}")], "format_version int, params string").write.json(str(tmp_path / "new/meta"))
    with pytest.raises(ValueError, match="version"):
        store.load(spark, str(tmp_path / "new"))
    store.save_bucketed(demo.index, "bucketed_ix", 2)
    assert spark.table("bucketed_ix").count() == 66
    spark.sql("drop table bucketed_ix")

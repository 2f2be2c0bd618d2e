"""Saved indexes: what lookups read of them; nearest matches of a hot core; one scan of the sequences."""

import random

from pyspark.sql import functions as F

from basewell.functions.params import IndexParams
from basewell.operators import match, windows
from basewell.plans import build
from basewell.sources import store

P = IndexParams(c=7, f=6)


def sequences(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"s{i}", "".join(rng.choices("ACGT", k=rng.randint(5, 400)))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "ref_id long, name string, seq string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_roundtrip(spark, tmp_path):
    made = build.build_index(sequences(spark), P)
    made.save(str(tmp_path / "ix"))
    index, keys, refs, p = store.load(spark, str(tmp_path / "ix"))
    assert p == P
    for found, given in ((index, made.index), (keys, made.keys), (refs, made.refs)):
        columns = sorted(given.columns)
        assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, given.select(columns).collect()), key=repr)
    assert len({r["part"] for r in index.parted.select("part").distinct().collect()}) > 20


def test_lookups_prune(spark, tmp_path):
    made = build.build_index(sequences(spark), P)
    made.save(str(tmp_path / "ix"))
    index = store.load(spark, str(tmp_path / "ix"))[0]
    asked = store.written(match.queries_of(sequences(spark, 1, 9), P).limit(5))
    for of in (match.all_matches, match.best_flex_match):
        found = of(asked.filter("qpos >= 0"), index)
        assert "dynamicpruning" in plan(found)
        columns = found.columns
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, of(asked, made.index).select(columns).collect()), key=repr)
    key = made.index.head()["key"]
    one = match.lookup(index, key)
    assert "(part#" in plan(one) and f"= {key >> store.part_shift(P)})" in plan(one)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, made.index.filter(F.col("key") == key).select(one.columns).collect()), key=repr)


def test_hot_core(spark):
    """One core with a third of all values and many equal flanks, asked for by many windows: right ties, and no window in the plan."""
    rng = random.Random(6)
    index = [(5, 3000, i, i % 11, rng.choice([0, 0, 0, rng.getrandbits(12)])) for i in range(3000)] + [(6, 2, 1, 4, None), (6, 2, 2, 4, None)] + [(7 + i, 3, i, 0, rng.getrandbits(12)) for i in range(200)]
    asked = [(1, q, 5, rng.choice([0, rng.getrandbits(12)])) for q in range(60)] + [(2, 0, 6, 3), (2, 1, 9, 3), (2, 2, 99999, 3)]
    found = match.best_flex_match(spark.createDataFrame(asked, "query_id long, qpos long, key long, flank long"), spark.createDataFrame(index, "key long, n long, ref_id long, pos long, flank long").repartition(5))
    assert "Window" not in plan(found)
    expected = []
    for q, at, key, flank in asked:
        met = [(r, p, None if f is None else sum((flank ^ f) >> 2 * i & 3 != 0 for i in range(16))) for k, _, r, p, f in index if k == key]
        best = [x for x in met if x[2] is None or x[2] == min(y[2] for y in met)]
        expected += [(q, at, key, r, p, d, None if d is None else len(best)) for r, p, d in best]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_one_scan(spark, tmp_path):
    """Statistics come from the scan that writes the occurrences."""
    sequences(spark).write.parquet(str(tmp_path / "s"))
    made = build.build_index(spark.read.parquet(str(tmp_path / "s")), P)
    assert f"{tmp_path}/s" not in plan(made.stats)
    row = made.stats.head()
    plain = windows.sampling(sequences(spark), P).head()
    assert (row["kmers"], row["sampled"], row["rate"], row["refs"]) == (*plain, 40)


def test_files(spark, tmp_path):
    """An index of FASTA files, split inside records and lines, is that of their sequences."""
    (tmp_path / "fa").mkdir()
    rows = [tuple(r) for r in sequences(spark, 12).collect()]
    for name, own in (("a", rows[:5]), ("b", rows[5:])):
        (tmp_path / "fa" / f"{name}.fa").write_text("".join(f">{n} of test\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for _, n, s in own))
    found, expected = build.build_files(spark, str(tmp_path / "fa"), P, split_bytes=300), build.build_index(sequences(spark, 12), P)
    for a, b in ((found.index, expected.index), (found.keys, expected.keys), (found.refs, expected.refs), (found.stats, expected.stats)):
        assert sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)



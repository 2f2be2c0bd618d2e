"""Prefix sums and ranks against plain Python; groups that fill many ranges."""

import random

from basewell.functions.params import IndexParams
from basewell.operators import index as ix
from basewell.operators import running


def test_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50), rng.randint(0, 5)) for i in rng.sample(range(10_000), 3000)]
    found = running.sums(spark.createDataFrame(rows, "k long, a long, b long").repartition(5), ["k"], "a", "b").collect()
    a = b = 0
    expected = []
    for k, x, y in sorted(rows):
        expected.append((k, x, y, a, b))
        a, b = a + x, b + y
    assert sorted(map(tuple, found)) == expected
    assert running.sums(spark.createDataFrame([], "k long, a long"), ["k"], "a").count() == 0


def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 7, *range(40)]), i) for i in rng.sample(range(10_000), 3000)]
    found = running.ranked(spark.createDataFrame(rows, "g long, v long").repartition(5), "g", ["v"], "place").collect()
    expected, seen = [], {}
    for g, v in sorted(rows):
        expected.append((g, v, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert sorted(map(tuple, found)) == expected
    one = running.ranked(spark.createDataFrame([(1, i) for i in range(500)], "g long, v long"), "g", ["v"], "place")
    assert all(r["v"] == r["place"] for r in one.collect())


def test_layout_of_wide_keys(spark):
    """Cores of 31 bases: keys of 62 bits; no row-wise window over them all."""
    rng = random.Random(4)
    p = IndexParams(c=31, f=0, allow_large_c=True)
    keys = sorted((k, rng.randint(1, 9)) for k in {rng.getrandbits(62) for _ in range(2000)} | {0, (1 << 62) - 1})
    found = ix.ranges(spark.createDataFrame(keys, "key long, n long"), p)
    at, expected = 0, []
    for k, n in keys:
        size = n + ((n + 1) // 2 if n > 2 else 0)
        expected.append((k, at, at + size))
        at += size
    assert sorted(tuple(r) for r in found.select("key", "v_start", "v_end").collect()) == expected


def test_pages(spark):
    """A key with a third of all values in one reference, one in many, and rare ones; pages give the index back."""
    rng = random.Random(5)
    rows = [(1, 9, p, p * 7) for p in range(700)] + [(2, r, 3, r) for r in range(650)] + [(3 + i, rng.randint(0, 9), i, None) for i in range(650)]
    sizes = {k: sum(x[0] == k for x in rows) for k in {x[0] for x in rows}}
    index = spark.createDataFrame([(k, sizes[k], r, p, f) for k, r, p, f in rows], "key long, n long, ref_id long, pos long, flank long").repartition(6)
    paged = ix.pages(index, 64)
    every = paged.collect()
    assert max(len(r["positions"]) for r in every) == 64
    for key in (1, 2):
        own = sorted((r for r in every if r["key"] == key), key=lambda r: r["page"])
        assert [r["page"] for r in own] == list(range(len(own))) and all(len(r["refs"]) == 64 for r in own[:-1])
        listed = [(r["first_ref"] + d, p) for r in own for d, p in zip(r["refs"], r["positions"], strict=True)]
        assert listed == sorted((x[1], x[2]) for x in rows if x[0] == key)
    assert sorted(map(tuple, ix.unpaged(paged).collect()), key=repr) == sorted(map(tuple, index.collect()), key=repr)

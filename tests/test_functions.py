import pytest
from pyspark.sql import functions as F

from basewell.functions import dna
from basewell.functions.params import IndexParams


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def test_words(spark):
    r = one(
        spark,
        code=dna.encode(F.lit("ACGT")),
        back=dna.decode(F.lit(27), 6),
        rc=dna.revcomp(F.lit("AACGT")),
        mid=dna.middle(F.lit("AACGTC"), 6, 4),
        fl=dna.flanks(F.lit("AACGTC"), 6, 4),
        least=dna.canonical(F.lit("TTT")),
    )
    assert r.asDict() == {"code": 27, "back": "AAACGT", "rc": "ACGTT", "mid": "ACGT", "fl": "AC", "least": "AAA"}


@pytest.mark.parametrize(("a", "b", "d"), [("ACGTACGT", "ACGTACGA", 1), ("AAAA", "TTTT", 4), ("ACGT", "ACGT", 0), ("A" * 16, "T" * 16, 16)])
def test_hamming(spark, a, b, d):
    assert one(spark, d=dna.hamming(dna.encode(F.lit(a)), dna.encode(F.lit(b))))["d"] == d


def test_packing(spark):
    r = one(spark, a=dna.pack(F.lit(1), F.lit(3)), b=dna.pack(F.lit(2**28 - 1), F.lit(5)), c=dna.pack(F.lit(2**28 - 1), F.lit(5), cell_mask=True), u=dna.unpack(F.lit(17179869187)), m=dna.unpack(F.lit(1152921487426977797)))
    assert (r["a"], r["b"], r["c"]) == (17179869187, 4611686001247518725, 1152921487426977797)
    assert tuple(r["u"]) == (1, 3) and tuple(r["m"]) == (2**26 - 1, 5)


@pytest.mark.parametrize(("core", "is_closed"), [("ACGTACG", True), ("TTACGTT", False), ("GACGTTT", False), ("CAAAAGT", False)])
def test_closed_syncmer(spark, core, is_closed):
    r = one(spark, text=dna.closed_syncmer(F.lit(core), 7, 3), number=dna.closed_syncmer_number(dna.encode(F.lit(core)), 7, 3), every=dna.closed_syncmer(F.lit(core), 7, 0))
    assert (r["text"], r["number"], r["every"]) == (is_closed, is_closed, True)


def test_range_sizes(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 7)], "n long").select(dna.range_cells("n", 2).alias("z")).collect()
    assert [r["z"] for r in rows] == [1, 2, 5, 6, 8, 11]
    rows = spark.createDataFrame([(z,) for z in (2, 5, 6, 8, 9, 11, 12)], "z long").select(dna.header_cells("z", 2).alias("h")).collect()
    assert [r["h"] for r in rows] == [0, 2, 2, 3, 3, 4, 4]


def test_params():
    assert IndexParams(c=15, cells_per_body=8).table_cells == 1610612740
    assert IndexParams(c=4, f=8, cells_per_body=8).table_cells == 388
    assert IndexParams(structural_cap=True).cap == 4096
    assert IndexParams(max_range_size=9, layout="hash").cap is None
    for bad in ({"c": 16}, {"f": 7}, {"f": 18}, {"cells_per_body": 12}, {"c": 1, "f": 2}, {"s": 16}, {"orient": "x"}, {"c": 31, "f": 2, "allow_large_c": True}):
        with pytest.raises(ValueError):
            IndexParams(**bad)

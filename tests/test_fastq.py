"""FASTQ in splits, trimming and Bloom filters."""

import random

import pytest

from basewell.operators import sketch
from basewell.sources import fastq

MARKS = "@+!5IJ"


@pytest.fixture(scope="module")
def reads(tmp_path_factory):
    """Files with qualities that begin like names and separators, empty reads, both line ends, a file of few lines and empty lines at ends."""
    rng, path, out = random.Random(8), tmp_path_factory.mktemp("fq"), []
    for f, n in enumerate((14, 1, 9)):
        text, end = "", rng.choice(["\n", "\r\n"])
        for _ in range(n):
            size = rng.choice([0, 1, 3, 30, 90])
            seq, qual = "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices(MARKS, k=size))
            out.append((len(out) + 1, f"r{len(out)}", seq, qual))
            text += f"@r{len(out) - 1} more{end}{seq}{end}+{rng.choice(['', 'again'])}{end}{qual}{end}"
        (path / f"{f}.fq").write_bytes((text + end * f).encode())
    return str(path), out


@pytest.mark.parametrize("split", [31, 97, 500, None])
def test_read(spark, reads, split):
    path, expected = reads
    assert sorted(map(tuple, fastq.read(spark, path, split_bytes=split).collect())) == expected


def test_small_batches(spark, reads):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, fastq.read(spark, reads[0]).collect())) == reads[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_malformed(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@ok x\nACGT\n+\nIIII\n@short\nACGT\n+\nIII\n@last\nAC\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record: @short"):
        fastq.read(spark, str(tmp_path)).collect()
    assert sorted((r["ref_id"], r["name"]) for r in fastq.read(spark, str(tmp_path), "DROPMALFORMED").collect()) == [(1, "ok"), (3, "last")]


def test_qualities(spark, reads):
    table = spark.createDataFrame(reads[1], "ref_id long, name string, seq string, qual string")
    for least in (0, 10, 31, 60):
        found = {r["ref_id"]: (r["seq"], r["qual"]) for r in fastq.trimmed(table, least).collect()}
        for i, _, seq, qual in reads[1]:
            n = max((k + 1 for k, c in enumerate(qual) if ord(c) - 33 >= least), default=0)
            assert found[i] == (seq[:n], qual[:n])
    for r in table.select("qual", fastq.errors("qual").alias("e")).collect():
        assert r["e"] == pytest.approx(sum(10 ** ((33 - ord(c)) / 10) for c in r["qual"]))


def test_bloom(spark):
    """No key is lost; few others pass; words are bounded."""
    keys, others = spark.range(0, 20_000, 7).withColumnRenamed("id", "key"), spark.range(20_000, 60_000).withColumnRenamed("id", "key")
    words = sketch.bloom(keys, bits=1 << 16)
    assert words.count() <= 1 << 10
    assert sketch.pruned(keys, words, bits=1 << 16).count() == keys.count()
    assert 0 < sketch.pruned(others, words, bits=1 << 16).count() < 0.03 * 40_000
    assert sketch.pruned(others, sketch.bloom(keys.limit(0))).count() == 0

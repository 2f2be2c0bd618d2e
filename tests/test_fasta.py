import random

import pytest

from basewell.sources import fasta

A = ">r1 desc one\nACGT\nacgt\r\nNN\n>r2\tx\nGG>G\n>r3 >odd\nTTTT"
B = ">s1\r\nAC\r\n\r\nGT\r\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("fa")
    (path / "a.fa").write_bytes(A.replace("GG>G", "GGG").encode())
    (path / "b.fa").write_bytes(B.encode())
    return str(path)


@pytest.mark.parametrize("read", [fasta.read_text, fasta.read_files])
def test_read(spark, folder, read):
    rows = sorted(map(tuple, read(spark, folder).collect()))
    assert rows == [(1, "r1", "ACGTACGTNN"), (2, "r2\tx", "GGG"), (3, "r3", "TTTT"), (4, "s1", "ACGT")]


@pytest.mark.parametrize("read", [fasta.read_text, fasta.read_files])
def test_invalid(spark, tmp_path, read):
    (tmp_path / "x.fa").write_text(">ok\nACGT\n>bad\nAC!T\n")
    with pytest.raises(Exception, match="not a nucleotide sequence: bad"):
        read(spark, str(tmp_path)).collect()
    assert [r["name"] for r in read(spark, str(tmp_path), "DROPMALFORMED").collect()] == ["ok"]


def test_names(spark):
    twice = spark.createDataFrame([(1, "a", "A"), (2, "a", "C"), (3, "b", "G")], "ref_id long, name string, seq string")
    with pytest.raises(Exception, match="duplicate reference name: a"):
        fasta.checked_names(twice).collect()
    assert [tuple(r) for r in fasta.checked_names(twice.filter("ref_id > 1")).orderBy("ref_id").collect()] == [(2, "a"), (3, "b")]


def test_dropped_records_keep_numbers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">bad\nAC!T\n>ok\nACGT\n")
    (tmp_path / "b.fa").write_text(">next\nAC\n")
    for read in (fasta.read_text, fasta.read_files):
        assert sorted((r["ref_id"], r["name"]) for r in read(spark, str(tmp_path), "DROPMALFORMED").collect()) == [(2, "ok"), (3, "next")]


@pytest.mark.parametrize(("split", "piece"), [(29, 1 << 20), (101, 7), (400, 50), (None, 1 << 20)])
def test_splits(spark, tmp_path, monkeypatch, split, piece):
    """Byte ranges that end anywhere: in headers, lines, records, before the first header; records without bases; files without records; all line ends."""
    monkeypatch.setattr(fasta, "PIECE", piece)
    rng, expected = random.Random(3), []
    for f in range(3):
        text = "no record\nACGT\n" if f == 1 else ""
        for _ in range(rng.randint(2, 5)):
            seq, width, end = "".join(rng.choices("ACGT", k=rng.choice([0, 1, 60, 61, 200]))), rng.choice([7, 60]), rng.choice(["\n", "\r\n"])
            expected.append((len(expected) + 1, f"r{len(expected)}", seq))
            text += f">{expected[-1][1]} text > more{end}" + end.join(seq[i : i + width] for i in range(0, len(seq), width)) + (end if seq else "") + rng.choice(["", end])
        (tmp_path / f"{f}.fa").write_bytes(text.encode())
    (tmp_path / "3.fa").write_text("nothing\n" * 30)
    assert sorted(map(tuple, fasta.read_files(spark, str(tmp_path), split_bytes=split).collect())) == expected
    parts = fasta.pieces(spark, str(tmp_path), split)
    assert sorted(map(tuple, fasta.names(parts).collect())) == [(i, n) for i, n, _ in expected]
    for whole in (parts, parts.withColumn("whole", parts["ref_id"] < 0)):
        found = [(r["ref_id"], r["start"] + i, r["seq"][i : i + 9]) for r in fasta.chunks(whole, 9, 40).collect() for i in range(len(r["seq"]) - 8)]
        assert sorted(found) == sorted((i, at, s[at : at + 9]) for i, _, s in expected for at in range(len(s) - 8))


def test_empty_folder(spark, tmp_path):
    (tmp_path / "a.fa").write_text("")
    assert fasta.read_files(spark, str(tmp_path)).count() == 0

"""An index built from a stream of files, and lookups in SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from basewell.functions import sql
from basewell.functions.params import IndexParams
from basewell.operators import match, windows
from basewell.plans import build
from basewell.sources import fasta
from basewell.streaming import builds

P = IndexParams(c=5, f=4, max_range_size=40)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, records in files.items():
        (folder / name).write_text("".join(f">{n} x\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) for n, s in records))


def files(seed, names):
    rng = random.Random(seed)
    hot = "ACGTACGGTACCA"  # its windows pass the cap in the first batches
    return {f"{n}.fa": [(f"{n}{i}", "".join(rng.choices("ACGT", k=rng.randint(0, 300))) + hot * rng.randint(0, 3)) for i in range(4)] for n in names}


@pytest.mark.parametrize("p", [P, IndexParams(c=5, f=4)])
def test_stream_is_batch(spark, tmp_path, p):
    """After any number of micro-batches and starts the index is that of all files together, whatever the cap; batches that run again count once."""
    source, path = tmp_path / "fa", str(tmp_path / "ix")
    write(source, files(1, "abcd"))
    builds.start(spark, str(source), path, p, files_per_trigger=1).awaitTermination()
    write(source, files(2, "ef") | {"empty.fa": []})
    builds.start(spark, str(source), path, p, files_per_trigger=2).awaitTermination()
    assert len([x for x in os.listdir(f"{path}/occurrences") if x.startswith("batch=")]) > 5
    # the last batch ran, but its end wasn't noted: it runs again
    commits = f"{path}/state/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for x in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(x):
            os.remove(x)
    builds.start(spark, str(source), path, p).awaitTermination()
    found, expected = builds.index_of(spark, path, p), build.build_files(spark, str(source), p)
    named = lambda x: rows(match.with_names(x.index, x.refs), "key", "n", "name", "pos", "flank")
    assert named(found) == named(expected) and rows(found.keys, "key", "n") == rows(expected.keys, "key", "n")
    assert rows(found.refs, "name") == rows(expected.refs, "name") and len({r["ref_id"] for r in found.refs.collect()}) == 24
    over = builds._table(spark, path, "over").select("key").distinct()
    assert (over.count() > 0) == (p.cap is not None)
    written, every = builds._table(spark, path, "occurrences").count(), windows.occurrences(fasta.read_files(spark, str(source)), p).count()
    assert written < every if p.cap else written == every


@pytest.mark.parametrize("p", [P, IndexParams(c=7, f=16, s=3), IndexParams(c=6, f=6, orient="kmer"), IndexParams(c=5, f=0)])
def test_sql(spark, p):
    rng = random.Random(5)
    data = [(i, f"s{i}", "".join(rng.choices("ACGTN" if i % 5 == 0 else "ACGT", k=rng.choice([0, 3, 60, 200])))) for i in range(40)]
    given = spark.createDataFrame([*data, (99, "null", None)], "ref_id long, name string, seq string")
    made = build.build_index(given, p)
    sql.attach(made.index, p, made.refs)
    given.createOrReplaceTempView("given")
    inside = spark.sql("select ref_id, w.pos, w.key, w.flank from (select ref_id, explode(w) as w from (select ref_id, kmer_occurrences(seq) as w from given))")
    assert rows(inside, "ref_id", "pos", "key", "flank") == rows(windows.occurrences(given, p), "ref_id", "pos", "key", "flank")
    assert spark.sql("select * from best_flex_match()").count() == 0
    asked = windows.occurrences(given.filter("ref_id < 6"), p).select(F.col("ref_id").alias("query_id"), F.col("pos").alias("qpos"), "key", "flank")
    asked.createOrReplaceTempView("kmer_queries")
    best = spark.sql("select * from best_flex_match()")
    assert "Window" not in best._jdf.queryExecution().toString()
    expected = match.best_flex_match(asked, made.index)
    assert rows(best, *expected.columns) == rows(expected, *expected.columns)
    every = spark.sql("select query_id, qpos, q.key, m.ref_id, m.rpos from kmer_queries q, lateral all_matches(q.key) m")
    assert rows(every, "query_id", "qpos", "key", "ref_id", "rpos") == rows(match.all_matches(asked, made.index), "query_id", "qpos", "key", "ref_id", "rpos")
    word = spark.sql(f"select dna_revcomp(dna_decode(key, {p.c})) as w from kmer_index limit 1").head()["w"]
    assert rows(spark.sql(f"select * from lookup('{word}')"), "ref_id", "pos") == rows(match.lookup_word(made.index, word), "ref_id", "pos")

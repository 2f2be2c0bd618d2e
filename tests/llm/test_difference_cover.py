import random

import pytest

from basewell.llm import difference_cover


def table(spark, symbols):
    return spark.createDataFrame(list(enumerate(symbols)), "pos long, sym long").repartition(3)


@pytest.mark.parametrize("symbols", [[1], [2, 1], [1, 1, 1, 1, 1, 1, 1], [3, 1, 2, 3, 1, 2, 3, 1, 2, 3], [random.Random(4).randint(1, 3) for _ in range(100)]])
def test_ranks(spark, symbols):
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    found = {r["pos"]: r["rank"] for r in difference_cover.suffix_ranks(table(spark, symbols)).collect()}
    assert [found[i] for i in order] == list(range(1, len(symbols) + 1))


def test_repeated_starts(spark):
    texts = ["xxabcdefgyy", "zabcdefgz", "", None, "aaaaaaaa", "é abcdé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raws, n = [(t or "").encode() for t in texts], 4
    every = [b[i : i + n] for b in raws for i in range(len(b) - n + 1)]
    expected = sorted((d, i) for d, b in enumerate(raws) for i in range(len(b) - n + 1) if every.count(b[i : i + n]) > 1)
    assert sorted((r["doc_id"], r["byte"]) for r in difference_cover.repeated_starts(docs, n).collect()) == expected

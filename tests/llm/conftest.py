import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=3000):
    out = []
    for i in range(n):
        w = "".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) if rng.random() < 0.3 else f"w{rng.randint(0, vocabulary)}"
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 40 == 39:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empties, odd white space and very long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 260)) for _ in range(60)]
    passage, line = prose(rng, 90), "The same line stands in many texts."
    out = []
    for i, t in enumerate(base):
        if i % 5 == 0:
            t = f"{line}\n{t}"
        if i % 6 == 0:
            t = t + "\n" + passage
        out.append(t)
    out += [out[0], out[0], out[12], out[12].replace("w1", "q1", 1)]
    words = out[18].split(" ")
    out += [" ".join([*words[:30], "changed", *words[31:]]), " ".join(words[:-2])]
    out += [None, "", " \t\n ", "one", "éé ñandú x y ÀÉ", "### $$$ %%% && |<>|" * 9, "again " * 400, ("a b c\n" * 200), prose(rng, 12000), "x" * 5000, "x" * 5000, "é" * 150, "日本語 " * 80, "A\r\nB\r\nA\r\n", "a\x1cb\x85c\x0bd"]
    table = [(i, t, ["en", "fr", None][i % 3] if i % 7 else "en", [None, "src1", "src2", "Src3", "hot", "hot", "hot"][i % 7], None if t is None else len(t)) for i, t in enumerate(out)]
    return [*table, table[12], table[12], (None, "no id " + passage, "en", "src1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_h", "_d", "_bad", "_stay", "_row", "_copy", "_pieces", "_d1", "node", "c", "n", "k", "size", "kept", "held", "bands", "_t", "_w", "spans", "key", "labels"]
    return docs.select("*", *[F.lit("?").alias(x) for x in names])

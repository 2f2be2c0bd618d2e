"""Windows, strands and keys against plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from basewell.functions.params import IndexParams
from basewell.operators import windows
from basewell.plans import catalogue

SIZES = [0, 1, 26, 27, 28, 31, 32, 33, 43, 48, 60, 200, 528, 1100, 17000]
PARAMS = [
    IndexParams(c=11, f=16, s=5),
    IndexParams(c=15, f=16, s=11),
    IndexParams(c=11, f=16, orient="kmer"),
    IndexParams(c=5, f=4, s=2),
    IndexParams(c=3, f=0),
    IndexParams(c=31, f=0, allow_large_c=True),
    IndexParams(c=16, f=16, allow_large_c=True, orient="kmer"),
    IndexParams(c=16, f=16, allow_large_c=True),
]


def _made():
    rng = random.Random(1)
    made = [(i, "".join(rng.choice("ACGT" * 12 + "Nn") for _ in range(n))) for i, n in enumerate(SIZES)]
    return [*made, (90, "ACGT" * 200), (91, "A" * 300), (92, "T" * 70 + "é\U0001f600" + "A" * 70), (93, None)]


def _number(word):
    return int(word.translate(str.maketrans("ACGT", "0123")), 4) if word else 0


def _turned(word):
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _words(k):
    return [(r, i, s[i : i + k]) for r, s in _made() if s for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def _expected(p):
    half = p.f // 2
    for r, i, x in _words(p.k):
        y = _turned(x)
        a, b = (x[half : half + p.c], y[half : half + p.c]) if p.orient == "core" else (x, y)
        taken = x if a < b else y
        core = taken[half : half + p.c]
        smers = [core[j : j + p.s] for j in range(p.c - p.s + 1)] if p.s else [core]
        if min(smers) in (smers[0], smers[-1]):
            yield r, i, _number(core), _number(taken[:half] + taken[half + p.c :])


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(_made(), "ref_id long, seq string")


@pytest.mark.parametrize("p", PARAMS, ids=str)
def test_occurrences(sequences, p):
    assert sorted(map(tuple, windows.occurrences(sequences, p).collect())) == sorted(_expected(p))


def test_encoded_and_turned(sequences):
    """Words are made in Arrow batches, not by string functions a row each."""
    for k in (1, 27, 31):
        found = windows.encoded(sequences, k)
        assert sorted(map(tuple, found.collect())) == [(r, i, x, _number(x), x) for r, i, x in _words(k)]
        turned = windows.turned(sequences, k + 5)
        assert sorted(map(tuple, turned.collect())) == [(r, i, x, _turned(x)) for r, i, x in _words(k + 5)]
    with pytest.raises(ValueError):
        windows.encoded(sequences, 32)


@pytest.mark.parametrize("name", ["kmer_encode", "kmer_revcomp"])
def test_words_of_a_table(spark, name):
    found = catalogue.queries()[f"indexed_{name}"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("MapInArrow")[0] for x in ("conv(", "translate(", "reverse("))


def test_kmers_and_spectrum(sequences):
    assert sorted(map(tuple, windows.kmers(sequences, 40).collect())) == _words(40)
    least = sorted((r, _number(min(x, _turned(x)))) for r, _, x in _words(31))
    assert sorted(map(tuple, windows.spectrum(sequences, 31).collect())) == least
    with pytest.raises(ValueError):
        windows.spectrum(sequences, 32)


@pytest.mark.parametrize("k", [5, 31])
def test_spectrum_counts(spark, k, monkeypatch):
    """References of several rows, of none, and longer sequences than are held; all by one shuffle of sums but for those."""
    monkeypatch.setattr(windows, "LONG", 1000)
    monkeypatch.setattr(windows, "COUNTED", 300)
    given = [*_made(), *[(r, s) for r, s in _made() if r in (5, 11, 90)], (None, "ACGT" * 20), (None, "ACGTA" * 20)]
    sequences = spark.createDataFrame(given, "ref_id long, seq string")
    n, refs = Counter(), defaultdict(set)
    for r, s in given:
        for i in range(len(s or "") - k + 1):
            if set(s[i : i + k]) <= set("ACGT"):
                key = _number(min(s[i : i + k], _turned(s[i : i + k])))
                n[key] += 1
                refs[key] |= {r} - {None}
    found = windows.spectrum_counts(sequences, k).collect()
    assert {r["key"]: (r["n"], r["n_refs"]) for r in found} == {x: (n[x], len(refs[x])) for x in n} and len(found) == len(n)
    once = windows.spectrum_counts(sequences.filter("ref_id < 5"), k)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2

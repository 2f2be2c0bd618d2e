"""Spelling variants, lexical search and online packing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import bag
from pyspark.sql import functions as F

from basewell.llm import lexical_search, online_packing, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LENGTH = 64


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- spelling variants


def plain_variants(rows, least_letters=7, least_count=2, ratio=10):
    counts = Counter()
    for d, t, *_ in rows:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_letters:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= least_count}
    cut = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), ws in cut.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n), key=repr)


def found_variants(df, **given):
    return bag(spelling.variants(df, **given), "word", "n", "n_near", "form", "form_n", "root")


@pytest.mark.parametrize("range_words", [20_000, 25])
def test_variants(docs, rows, clashing, no_docs, range_words):
    expected = plain_variants(rows, 3, 1)
    assert any(x[3] for x in expected) and any(x[2] > 2 for x in expected)
    assert found_variants(clashing, least_letters=3, least_count=1, range_words=range_words) == expected
    assert found_variants(docs, range_words=range_words) == plain_variants(rows)
    assert found_variants(no_docs) == []


@pytest.mark.parametrize("range_words", [1, 7, 1000])
def test_dense_words(spark, range_words):
    """Few letters, so that nodes have many children, runs of equal letters and words that begin others; nodes in many ranges; long words; chains of forms."""
    rng = random.Random(range_words)
    words = {"".join(rng.choices("abß", k=rng.randint(2, 7))) for _ in range(300)} | {"a" * k for k in range(2, 9)} | {"q" * 200, "q" * 201, "q" * 100 + "r" + "q" * 99, "q" * 199 + "r", "q" * 150 + "s" + "q" * 49}
    texts = [" ".join(w for w in sorted(words) for _ in range(rng.choice([1, 1, 2, 12, 150]))) for _ in range(2)]
    table = [(1, texts[0]), (2, texts[1]), (3, None)]
    expected = plain_variants(table, 2, 1, 3)
    assert any(x[5] not in (x[0], x[3]) for x in expected)
    assert found_variants(spark.createDataFrame(table, "doc_id long, text string"), least_letters=2, least_count=1, ratio=3, range_words=range_words) == expected


def test_light_terminals():
    """A word leaves at most log2 of all words' nodes by a light child."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh", [9, 5, 3, 2, 1, 1, 1, 1], k=rng.randint(4, 12))) for _ in range(3000)})
    trie = spelling.Trie(words, None, None)
    per_word = Counter(i for i, _ in spelling.terminals(trie, {}, 1))
    assert max(per_word.values()) <= 4 * math.log2(len(words))


# --- lexical search


def plain_search(rows, items, k):
    docs = [(d, Counter(TERM.findall(lower(t)))) for d, t, *_ in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_all, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(x for _, c in docs for x in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lower(text)))
        scored = []
        for d, c in docs:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 20 * m)) for x in terms if c[x])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block_words"), [(50, 1_000_000), (3, 100)])
def test_search(spark, docs, rows, clashing, no_docs, monkeypatch, k, block_words):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 20)
    items = [(1, rows[3][1]), (2, "The same line"), (2, "The same line"), (3, None), (4, ""), (5, "nothing-of-this 12345"), (None, "w1 w2 W3 w1"), (7, rows[6][1]), (8, "éé 日本語 again")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("?"))
    found = lexical_search.search(clashing, table, k, block_words)
    assert bag(found, "item_id", "rank", "doc_id", "score") == plain_search(rows, items, k)
    assert lexical_search.search(no_docs, table).count() == 0
    assert lexical_search.search(docs, table.limit(0)).count() == 0
    assert lexical_search.search(docs.filter("text is null"), table).count() == 0


def test_search_ties(spark):
    """More equal scores than fit, over several tasks; nulls last."""
    table = spark.createDataFrame([(i, "same words") for i in range(200, 0, -1)] + [(None, "same words"), (0, "other")], "doc_id long, text string").repartition(7)
    found = lexical_search.search(table, spark.createDataFrame([("a", "words")], "item_id string, text string"))
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 51)]
    few = lexical_search.search(table.filter("doc_id < 4 or doc_id is null"), spark.createDataFrame([("a", "words")], "item_id string, text string"))
    assert [r["doc_id"] for r in few.orderBy("rank").collect()] == [1, 2, 3, None]


# --- online packing


@pytest.mark.parametrize(("length", "windows", "shards_per_group"), [(LENGTH, 4, 2), (4096, 64, 64)])
def test_online_packing(docs, rows, clashing, no_docs, length, windows, shards_per_group):
    tok = online_packing.encoder().tokenizer
    given = {"length": length, "windows": windows, "shards_per_group": shards_per_group}
    packed = online_packing.pack(clashing, **given)
    sequences = packed.collect()
    assert len({r["sequence_id"] for r in sequences}) == len(sequences)
    parts = defaultdict(list)
    for r in sequences:
        ids, at = np.frombuffer(r["input_ids"], "<u4").tolist(), 0
        assert 0 < len(ids) == r["n_used"] == sum(r["lengths"]) <= length
        assert len(ids) & (len(ids) - 1) == 0 or length - len(ids) <= online_packing.SLACK
        for d, s, n, total in zip(r["doc_ids"], r["starts"], r["lengths"], r["doc_tokens"], strict=True):
            assert n > 0
            parts[d, total].append((s, ids[at : at + n]))
            at += n
    expected = Counter((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, online_packing.END_ID])) for d, t, *_ in rows)
    for (d, ids), copies in expected.items():
        own = parts.pop((d, len(ids)))
        assert sum(len(x) for _, x in own) == copies * len(ids)
        covered = Counter()
        for s, x in own:
            assert tuple(x) == ids[s : s + len(x)]
            covered.update(range(s, s + len(x)))
        assert set(covered.values()) == {copies}
    assert not parts
    assert online_packing.pack(no_docs).count() == 0
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    once, again = (bag(online_packing.pieces(online_packing.pack(docs, **given)), *columns) for _ in range(2))
    assert once == again


def test_pieces(docs):
    packed = online_packing.pack(docs, 32, windows=3)
    expected = []
    for r in packed.collect():
        at = 0
        for d, s, n, total in zip(r["doc_ids"], r["starts"], r["lengths"], r["doc_tokens"], strict=True):
            expected.append((d, s, n, zlib.crc32(r["input_ids"][4 * at : 4 * (at + n)]), total, r["sequence_id"], at))
            at += n
    assert bag(online_packing.pieces(packed), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset") == sorted(expected, key=repr)


def test_bounded_windows():
    """Never more open sequences than allowed; a piece goes where least room is left."""
    rng = random.Random(4)
    space, sizes, full = online_packing.Windows(100, 5, 2), [rng.randint(1, 60) for _ in range(2000)], []
    for i, n in enumerate(sizes):
        fitting = [room for room, _ in space.rooms if room >= n]
        before = dict(space.held)
        full += list(space.place((i, 0, np.zeros(n, np.uint32), n)))
        assert len(space.held) <= 5 and space.rooms == sorted(space.rooms)
        if fitting and min(fitting) > n:
            assert {100 - sum(len(p[2]) for p in space.held[k]) for k in before} >= {min(fitting) - n}
    assert all(98 <= sum(len(p[2]) for p in row) <= 100 for row in full)
    assert sum(len(p[2]) for row in [*full, *space.left()] for p in row) == sum(sizes)
    strung = list(online_packing.strung([(0, 0, np.zeros(150, np.uint32), 150), (1, 0, np.zeros(85, np.uint32), 85)], 64))
    assert [sum(len(p[2]) for p in row) for row in strung] == [64, 64, 64, 32, 8, 2, 1]


def test_long_texts(spark, monkeypatch):
    """Texts beyond a buffer give the plain tokenizer's ids."""
    monkeypatch.setattr(online_packing.common, "CHUNK_BYTES", 1000)
    texts = ["word and more\t" * 500, "x" * 5000, " " * 5000, "é　ñ " * 700, "a" * 999 + " b" * 600]
    assert_plain(texts)


def assert_plain(texts):
    for vocabulary in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = online_packing.encoder(vocabulary)
        assert enc.by_word == vocabulary.startswith("word")
        plain = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in enc.encoded(texts)] == plain


def test_words(monkeypatch):
    """Word by word gives the plain tokenizer's ids, remembered or not, for capitals, marks, contractions, digits, special tokens and other scripts."""
    letters = ["a", "b", "s", "t", "S", "é", "É", "ß", "İ", "ﬁ", "日", "e\u0301", "\u0301", "'", "’", ".", ",", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "²", " ", " ", " ", "\n", "\x1c", "\u2003", "don't", "it's", "—", "ª", "ǅ", "Ω"]
    rng = random.Random(9)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    assert_plain(texts)
    monkeypatch.setattr(online_packing, "WORDS", 50)
    assert_plain(texts[:200])

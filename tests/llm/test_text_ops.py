"""Quality rules, license scan, decontamination and line dedup against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import bag

from basewell.llm import common, decontaminate, licenses, lines, quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words(rows, monkeypatch):
    for _, t, *_ in rows:
        assert [w.decode() for w in common.words(t, common.LOWER_ALNUM)] == ALNUM.findall(lower(t))
        assert [w.decode() for w in common.words(t, common.SPACED)] == SPACED.findall(t or "")
    texts = [t for _, t, *_ in rows]
    h, n = common.word_hashes(texts, common.LOWER_SPACED)
    words = [w for t in texts for w in SPACED.findall(lower(t))]
    assert len(words) == len(h) == n.sum() and len(set(h.tolist())) == len(set(words))
    assert len({*zip(words, h.tolist(), strict=True)}) == len(set(words))
    assert np.array_equal(h, np.concatenate([common.word_hashes([t], common.LOWER_SPACED)[0] for t in texts]))
    for small in (1, 7, 300):
        monkeypatch.setattr(common, "CHUNK_BYTES", small)
        again = common.word_hashes(texts, common.LOWER_SPACED)
        assert np.array_equal(h, again[0]) and np.array_equal(n, again[1])


def quality_counts(t):
    t = t or ""
    w = SPACED.findall(t)
    found = [x for x in t.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(found) - len(set(found)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality(docs, rows, no_docs, clashing):
    found = quality.assess(docs)
    assert bag(found, "doc_id", *BASE) == sorted(((i, *quality_counts(t)) for i, t, *_ in rows), key=repr)
    assert all(not r["kept"] for r in found.collect() if r["base_failed"])
    assert quality.assess(no_docs).count() == 0 and quality.filtered(no_docs).count() == 0
    kept = quality.filtered(clashing)
    assert kept.columns == clashing.columns
    # rows without a doc_id each follow their own verdict
    failed = {(r["doc_id"], r["n_words"]) for r in found.collect() if not r["kept"]}
    assert bag(kept, "doc_id", "text") == sorted(((i, t) for i, t, *_ in rows if (i, quality_counts(t)[0]) not in failed), key=repr)
    assert any(i is None for i, _ in failed) and kept.filter("doc_id is null").count() == 1


def test_quality_fences(spark):
    """One group's usual value is another's outlier; few documents are judged by their language."""
    text = lambda i, marks: " ".join(f"word{i}x{j}{'#' * marks}" for j in range(60))
    table = [(i, text(i, 3 if i < 60 else 0), "en", "code" if i < 60 else "prose") for i in range(120)]
    table += [(200, text(200, 3), "en", "prose"), (201, text(201, 3), "en", "code"), (202, text(202, 1), "en", "rare"), (203, text(203, 9), "fr", None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(200) and all(kept.values())


def test_quality_fences_move(spark):
    """Each rule's fence moves with its group: the same document passes in the group where its ratio is usual and fails in the other."""
    text = lambda i, n=60, size=0: " ".join(f"word{i}x{j}".ljust(size, "y") for j in range(n))
    line = " ".join(f"again{j}" for j in range(22))
    usual = {
        "symbol_ratio": lambda i: text(i, 50) + " ###" * 9,
        "dup_line_ratio": lambda i: "\n".join([*(text(f"{i}z{k}", 20) for k in range(4)), *["end here"] * 4]),
        "repeat_ratio": lambda i: f"{line} {text(i, 250)} {line}",
        "mean_word": lambda i: text(i, 60, 30),
    }
    table = [(i, text(i), "en", "plain") for i in range(60)]
    for k, (rule, marked) in enumerate(usual.items()):
        table += [(1000 * (k + 1) + i, marked(i), "en", rule) for i in range(40)]
        table.append((100 + k, marked(500), "en", "plain"))
    own = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r["broken"] for r in quality.assess(own).collect()}
    assert {i: b for i, b in found.items() if b} == {100 + k: rule for k, rule in enumerate(usual)}
    high = {r["source"]: r for r in quality.fences(quality.measure(own)).filter("not whole").collect()}
    assert all(high[rule][f"{rule}_high"] > 1.5 * high["plain"][f"{rule}_high"] for rule in usual)


def test_quality_rules_act(spark):
    """Each rule alone rejects a document that the base rule passes."""
    text = lambda i, n=60: " ".join(f"word{i}x{j}" for j in range(n))
    table = [(i, text(i), "en", "s") for i in range(60)]
    line = " ".join(f"again{j}" for j in range(21))
    table += [(100, text(100, 50) + " ###" * 9, "en", "s"), (101, "\n".join([text(101), *["end here"] * 4]), "en", "s"), (102, f"{line} {text(102, 250)} {line}", "en", "s"), (103, " ".join(f"{j:030}" for j in range(40)), "en", "s")]
    table += [(104, f"{text(104)}\nend here\nend here", "en", "s")]  # one repeated line
    own = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality.assess(own).collect()}
    assert [found[100 + i]["broken"] for i in range(5)] == ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", ""]
    assert not any(found[100 + i]["base_failed"] for i in range(5)) and {i for i, r in found.items() if not r["kept"]} == {100, 101, 102, 103}


def test_licenses(docs, rows, spark, no_docs, clashing):
    texts = dict.fromkeys(range(6))
    notice = licenses.TEMPLATES[0][1]
    half = " ".join(notice.split()[: len(notice.split()) // 2])
    changed = " ".join(w for i, w in enumerate(notice.split()) if i % 9)
    texts = [f"Intro\n{notice}\nend", half, f"x {changed} and more words", notice.replace(", ", ",\n"), "MIT-License, mit license MIT License! Apache\nlicense general PUBLIC license", "general public licenses", None]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(own).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["mit", "", "mit", "mit", "apache,gpl,mit", "", ""]
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["base_labels"], got[4]["score"]) == (5, 0, 8, "apache,gpl,mit", 1.0)
    assert got[0]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1 and got[1]["score"] == 0 and got[6]["n_words"] == 0 and got[6]["first_word"] is None
    assert got[0]["blocks"][0]["first_line"] == 1
    with pytest.raises(ValueError, match="too large to broadcast"):
        licenses.scan(own, [("x", "w " * (licenses.MOST_TEMPLATE_BYTES // 2 + 1))])
    # the filtered join finds what comparing every block with every template finds
    sets = [set(ALNUM.findall(lower(t))) for _, t in licenses.TEMPLATES]
    for t in [*texts, *(x for _, x, *_ in rows)]:
        blocks = [set(ALNUM.findall(lower(b))) for p in re.split(r"\n(?=[^0-9a-zA-Z\x80-\U0010ffff]*(?:\n|$))", t or "") for b in [p, *p.split("\n")]]
        plain = {licenses.TEMPLATES[k][0] for k, s in enumerate(sets) for b in blocks if len(s & b) >= 0.8 * len(s)}
        r = licenses.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).head() if t in texts else None
        assert r is None or plain <= set(r["labels"].split(","))
    assert bag(licenses.scan(clashing), "doc_id", "n_words") == sorted(((i, len(ALNUM.findall(lower(t)))) for i, t, *_ in rows), key=repr)
    assert licenses.scan(no_docs).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    words = ALNUM.findall(rows[3][1])
    items = [(1, " ".join(words[4:30])), (10, "The same line stands"), (2, rows[6][1]), (3, None), (4, "..."), (5, "one"), (2, " ".join(words[:12])), (None, rows[9][1]), (7, "nowhere to be found in any of the texts that are here today")]
    return spark.createDataFrame(items, "item_id long, text string")


def contaminated(rows, items, window=10):
    index = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, its = ALNUM.findall(lower(t)), set(), set()
        for n in {len(x) for x in index}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in index:
                    hit.update(range(k, k + n))
                    its |= index[tuple(w[k : k + n])]
        names = sorted(str(x) for x in its if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(docs, rows, benchmark, block):
    found = decontaminate.report(docs, benchmark, block_words=block)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert bag(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contaminated(rows, items)


def test_decontamination_cleans(spark, docs, no_docs, benchmark, clashing):
    out = decontaminate.cleaned(clashing, benchmark)
    assert out.columns == clashing.columns
    assert not any(r["n_hit"] for r in decontaminate.report(out, benchmark.filter("item_id in (1, 10)")).collect())
    empty = benchmark.filter("false")
    assert decontaminate.report(no_docs, benchmark).count() == 0 and decontaminate.cleaned(docs, empty).count() == docs.count()
    assert not any(r["contaminated"] for r in decontaminate.report(docs, empty).collect())
    one = spark.createDataFrame([(1, "Keep, this (part one two three four five) and that!", 9)], "doc_id long, text string, n_chars long")
    item = spark.createDataFrame([(1, "One TWO three four five")], "item_id long, text string")
    r = decontaminate.cleaned(one, item).head()
    assert r["text"] == "Keep, this (part ) and that!" and r["n_chars"] == len(r["text"])
    assert decontaminate.cleaned(one, item, drop_share=0.3).count() == 0


@pytest.mark.parametrize("block", [1, 20, 60])
def test_decontamination_blocks(spark, docs, benchmark, clashing, block):
    """However the benchmark is cut into blocks, the same words and documents go."""
    text = lambda **params: bag(decontaminate.cleaned(docs, benchmark, **params), "doc_id", "text", "n_chars")
    assert text(block_words=block) == text() and decontaminate.cleaned(clashing, benchmark, block_words=block).columns == clashing.columns
    items = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g h i j", 19)], "doc_id long, text string, n_chars long")
    left = lambda *texts, share: [(r["text"], r["n_chars"]) for r in decontaminate.cleaned(one, items(*texts), drop_share=share, block_words=block).collect()]
    assert left("a b c", "d e f", share=0.5) == []  # 3 and 3 of 10
    assert left("b c d", "d e f", share=0.9) == [("a  g h i j", 10)]  # windows that overlap
    assert left("b c", "a d", share=0.9) == [("a  d e f g h i j", 16)]  # a and d don't stand together


def deduped(rows, n=3):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, {}
    for i in order:  # repeated rows of one id are equal here
        ls = (rows[i][1] or "").split("\n")
        gone = set()
        for p in range(len(ls) - n + 1):
            w = tuple(ls[p : p + n])
            if SPACED.search("".join(w)):
                if w in seen:
                    gone.update(range(p, p + n))
                seen[w] = True
        runs = sum(1 for g in gone if g - 1 not in gone)
        out[i] = (rows[i][0], len(ls), len(gone), runs, "\n".join(x for j, x in enumerate(ls) if j not in gone))
    return sorted(out.values(), key=repr)


def test_lines(docs, rows, no_docs, clashing):
    assert bag(lines.dedupe(clashing), "doc_id", "n_lines", "n_removed", "n_spans", "text") == deduped(rows)
    assert lines.dedupe(no_docs).count() == 0


def test_equal_lines_rows(spark, monkeypatch):
    """However many equal rows there are, with or without a doc_id, the first alone may keep what no other document has."""
    monkeypatch.setattr(lines, "PORTION", 3)
    table = [(7, "a\nb\nc\nd")] * 8 + [(None, "x\ny\nz")] * 5 + [(None, "y\nz\nq")] + [(9, "one line")] * 4
    found = bag(lines.dedupe(spark.createDataFrame(table, "doc_id long, text string").repartition(3)), "doc_id", "n_removed", "text")
    assert found == sorted([(7, 0, "a\nb\nc\nd")] + [(7, 4, "")] * 7 + [(None, 0, "x\ny\nz")] + [(None, 3, "")] * 4 + [(None, 0, "y\nz\nq")] + [(9, 0, "one line")] * 4, key=repr)


def test_lines_small(spark):
    t = ["a\nb\nc\nd", "x\na\nb\nc\nb\nc\nd\ne", "\n\n\n\n", "\n\n\n", "b\nc\nd\na\nb\nc"]
    found = {r["doc_id"]: (r["text"], r["n_spans"]) for r in lines.dedupe(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert found == {0: (t[0], 0), 1: ("x\ne", 1), 2: (t[2], 0), 3: (t[3], 0), 4: ("", 1)}

"""Packing, n-gram join, mixing, repeats, Katz scores and the pipeline against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import bag

from basewell.llm import katz, mixing, ngram_join, packing, suffix_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def unpacked(df, length, kind="<u2"):
    found = []
    for r in df.collect():
        ids, positions = np.frombuffer(r["input_ids"], kind), np.frombuffer(r["position_ids"], kind)
        cu = r["cu_seqlens"]
        assert len(ids) == len(positions) == length and cu[0] == 0 and cu[-1] == r["n_used"] <= length
        for a, z, d, o in zip(cu[:-1], cu[1:], r["doc_ids"], r["doc_offsets"], strict=True):
            assert a < z and np.array_equal(positions[a:z], np.arange(z - a))
            found.append((d, o, ids[a:z].tolist()))
    return found


@pytest.mark.parametrize(("length", "group"), [(64, 500), (2048, 2_000_000)])
def test_packing(docs, rows, no_docs, clashing, length, group):
    enc = packing.encoder()
    pieces = unpacked(packing.pack(clashing, length, group_tokens=group), length)
    expected = []
    for d, t, *_ in rows:
        ids = [*enc.encode_ordinary(t or ""), packing.END_ID]
        expected += [(d, a, ids[a : a + length]) for a in range(0, len(ids), length)]
    assert sorted(pieces, key=repr) == sorted(expected, key=repr)
    assert packing.pack(no_docs).count() == 0
    assert bag(packing.pack(docs, length, group_tokens=group), "shard", "row", "input_ids") == bag(packing.pack(docs, length, group_tokens=group), "shard", "row", "input_ids")


def test_best_fit():
    rng = np.random.default_rng(2)
    for n, most in ((0, 5), (1, 1), (300, 50), (500, 97)):
        lengths = rng.integers(1, most + 1, n).tolist()
        rows, plain = packing.best_fit(lengths, most), []
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            fitting = [(most - sum(lengths[j] for j in b), k) for k, b in enumerate(plain) if sum(lengths[j] for j in b) + lengths[i] <= most]
            if fitting:
                plain[[k for room, k in fitting if room == min(fitting)[0]][-1]].append(i)
            else:
                plain.append([i])
        load = lambda packed: sorted(sum(lengths[i] for i in b) for b in packed)  # noqa: B023, E731
        assert load(rows) == load(plain) and sorted(x for b in rows for x in b) == list(range(n))
        assert all(sum(lengths[i] for i in b) <= most for b in rows) and len(rows) == len(plain)


def test_long_runs(spark):
    """White space that the tokenizer's pattern can't match; elsewhere the ids are the plain tokenizer's."""
    enc, run = packing.encoder(), packing.RUN
    for c in (" ", "\t", "\n", "\u3000", " \n\t"):
        for n in (run - 1, run, run + 1, 60_000):
            space = (c * n)[:n]
            for t in (space, f"a{space}", f"{space}b", f"one {space}two.{space}", f"x{space}3 y\x1c{space}'s"):
                assert packing.encoded(enc, t).tolist() == enc.encode_ordinary(t)
    texts = [" " * 3_000_000, "\t" * 3_000_000, f"a {chr(10) * 3_000_000} b", "word" * 750_000, ("x y" + " " * 1_500_000) * 2]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {}
    for d, o, ids in unpacked(packing.pack(table), packing.ROW_LENGTH):
        parts.setdefault(d, []).append((o, ids))
    for d, t in enumerate(texts):
        ids = [x for _, own in sorted(parts[d]) for x in own]
        assert ids[-1] == packing.END_ID and enc.decode(ids[:-1]) == t


def links(rows, n=5, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    near = [[bool(a and b) and len(a & b) >= threshold * len(a | b) for b in sets] for a in sets]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if near[i][j] or i == j) for i in range(len(rows))]
    return sets, near, group


def test_ngram_join(docs, rows, no_docs, clashing):
    named = [r for r in rows if r[0] is not None]
    _, near, group = links(named)
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, 1 << 60), named[i][0])
    expected = sorted((r[0], least[group[i]], sum(near[i]) - bool(near[i][i])) for i, r in enumerate(named))
    found = ngram_join.join(docs.filter("doc_id is not null"))
    assert sorted(tuple(r) for r in found.select("doc_id", "class_id", "n_links").collect()) == expected
    assert ngram_join.join(no_docs).count() == 0
    assert ngram_join.join(docs).count() == len(rows)
    kept = ngram_join.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(least.values()))
    assert kept.filter("doc_id is null").count() == 2


def test_repeated_ids(spark):
    """Rows of one doc_id follow their own texts; copies without a doc_id go too."""
    text = lambda k: " ".join(f"{k}word{j}" for j in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("b")), (None, text("a")), (None, text("c")), (None, text("c")), (None, text("d")), (4, text("e")), (4, text("e")), (5, ""), (5, "..."), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (4, text("e")), (5, ""), (5, "..."), (None, None)], key=repr)
    assert all(bag(ngram_join.deduplicated(table.repartition(n)), "doc_id", "text") == expected for n in (1, 5))


def test_ngram_blocks(spark):
    """A group over several blocks gives the links that one block gives."""
    words = [f"w{i}" for i in range(120)]
    table = [(i, " ".join([*words[: 10 + i % 40], f"x{i}", *words[11 + i % 40 :]])) for i in range(90)]
    own = spark.createDataFrame(table, "doc_id long, text string")
    _, near, group = links(table)
    for block in (8, 200):
        found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(own, block=block).collect()}
        assert found == {i: (group[i], sum(near[i]) - 1) for i in range(90)}


def test_bands():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def shares(sizes):
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight, target, free, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def spark_hash(*parts):
    """Spark's xxhash64 of longs, ints (as given by a pair) and strings."""
    seed = 42
    for x in parts:
        if x is not None:
            raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True) if isinstance(x, int) else x[0].to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def taken_plain(rows, target, block):
    """Words taken of each row: the words of a source in order, in blocks, epoch after epoch in the permuted order, until the target is reached."""
    out = [0] * len(rows)
    size = [len(SPACED.findall(r[1] or "")) for r in rows]
    for s in {r[3] for r in rows}:
        own = sorted((i for i, r in enumerate(rows) if r[3] == s and size[i]), key=lambda i: (spark_hash(rows[i][0], (mixing.SEED,)) % 256, rows[i][0] is not None, rows[i][0] or 0, spark_hash(rows[i][1])))
        words = [i for i in own for _ in range(size[i])]
        blocks = [words[a : a + block] for a in range(0, len(words), block)]
        left, slot = math.floor(target[s] + 0.5), 0
        while left > 0:
            epoch, place = divmod(slot, len(blocks))
            b = mixing.permuted(np.array([place]), len(blocks), mixing._key(mixing.SEED, s, epoch))[0]
            for i in blocks[b][:left]:
                out[i] += 1
            left -= len(blocks[b][:left])
            slot += 1
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_mixing(docs, rows, no_docs, clashing, block):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(SPACED.findall(t or ""))
    target = shares(size)
    found = mixing.taken(docs, block_words=block, slots_per_shard=40)
    words = [len(SPACED.findall(t or "")) for _, t, *_ in rows]
    plain = taken_plain(rows, target, block)
    got, wanted = bag(found, "doc_id", "size", "source_size", "taken"), sorted(((r[0], words[i], size[r[3]], plain[i]) for i, r in enumerate(rows)), key=repr)
    assert got == wanted, [(a, b) for a, b in zip(got, wanted, strict=True) if a != b]
    for r in found.collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["first_shard"] is not None) == (r["taken"] > 0) == (r["n_shards"] > 0)
        assert any(math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) for s in size if size[s] == r["source_size"])
    assert bag(found, *found.columns) == bag(mixing.taken(docs.repartition(5), block_words=block, slots_per_shard=40), *found.columns)
    assert mixing.taken(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(clashing, block_words=block, slots_per_shard=40, with_shard=True)
    assert out.columns == [*clashing.columns, "shard"] and mixing.mixed(clashing).columns == clashing.columns
    each, sources, shards = Counter(), Counter(), {}
    for r in out.collect():
        each[r["doc_id"]] += len(SPACED.findall(r["text"]))
        sources[r["source"]] += len(SPACED.findall(r["text"]))
        shards.setdefault(r["doc_id"], set()).add(r["shard"])
        assert r["n_chars"] == len(r["text"])
    expected = Counter()
    for r in found.collect():
        expected[r["doc_id"]] += r["taken"]
        if r["taken"] and r["doc_id"] not in (None, 12):  # rows of these ids share them
            assert (r["first_shard"], r["n_shards"]) == (min(shards[r["doc_id"]]), len(shards[r["doc_id"]]))
    assert +each == +expected and all(abs(sources[s] - target[s]) <= 1 for s in size)


def test_shards_are_drawn(spark, docs):
    """A shard's source counts vary as binomial draws do, parts of the tree agree with the whole, and slots follow the draws."""
    for shards in (1, 2, 7, 50):
        spread = []
        for key in range(300):
            whole = list(mixing.halved(4000, shards, key))
            assert [x for a in range(0, shards, 3) for x in mixing.halved(4000, shards, key, a, a + 3)] == whole
            counts = np.zeros(shards)
            at = 0
            for shard, first, n in whole:
                assert first == at and n > 0
                counts[shard], at = n, at + n
            assert at == 4000
            spread.append(((counts - 4000 / shards) ** 2).sum() / (4000 / shards))
        assert shards == 1 or 0.85 < np.mean(spread) / (shards - 1) < 1.15
    sources = mixing.common.cut(mixing.targets(mixing._sized(docs)))
    made, where = mixing.slots(sources, 4, 100).groupBy("k", "shard").count(), {}
    for r in made.collect():
        where.setdefault(r["k"], {})[r["shard"]] = r["count"]
    names = {r["k"]: r["source"] for r in sources.collect()}
    n = 1 + max(x for own in where.values() for x in own)
    for k, own in where.items():
        assert own == {shard: x for shard, _, x in mixing.halved(sum(own.values()), n, mixing._key(mixing.SEED, "shards", names[k]))}


def test_permutation():
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 77)
        assert sorted(p) == list(range(n)) and np.array_equal(mixing.permuted(p, n, 77, inverse=True), np.arange(n))


def test_one_source(spark):
    own = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, " ", "t")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in mixing.taken(own).collect()}
    assert rows == {1: (3, 3, 3.0, 3, 0, 1), 2: (0, 3, 3.0, 0, None, 0), 3: (0, 0, 0.0, 0, None, 0)}


def without_repeats(rows, n=200):
    raws = [(r[1] or "").encode() for r in rows]
    count = Counter(b[i : i + n] for b in raws for i in range(len(b) - n + 1))
    out = []
    for r, b in zip(rows, raws, strict=True):
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                for j in range(max(i, end), i + n):
                    gone[j] = 1
                end = i + n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 24, 300])
def test_repeats(docs, rows, no_docs, clashing, most):
    from pyspark.sql import functions as F

    found = suffix_dedup.dedupe(clashing, most_keys=most).withColumn("sha", F.sha2("kept", 256))
    assert bag(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == without_repeats(rows)
    assert suffix_dedup.dedupe(no_docs).count() == 0


def test_repeats_at_edges(spark):
    """199 shared bytes stay, 200 go; repeats that overlap themselves; a period; differing sides of one passage; a long text."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c = text(199), text(200), text(330)
    texts = [text(50) + a + text(40), a, text(9) + b + text(300), b + text(7), "ab" * 150, "ab" * 100, text(10) + "abc" * 80, *[text(60) + c[i * 7 : 250 + i * 7] + text(60) for i in range(9)], text(1000) * 2, text(300_000), None, c]
    texts.append(texts[-3][150_000:150_260] + "é" * 101)
    rows = [(i, t) for i, t in enumerate(texts)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    found = suffix_dedup.dedupe(own).withColumn("sha", F.sha2("kept", 256))
    assert bag(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == without_repeats(rows)


def katz_plain(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    tokens = [[*SPACED.findall(lower(t)), "\0end"] for _, t, *_ in rows]
    one, two, total = Counter(), Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            one.update(w)
            for a, b in zip(["\0start", *w], w):
                two[a, b] += 1
                total[a] += 1
    n, v = sum(one.values()), len(one)
    of = lambda c: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])
    d1, d2 = of(one), of(two)
    less = lambda x, d: x * (d[x - 1] if x <= katz.K else 1)
    word = {w: less(c, d1) / (n + katz.PSEUDO) for w, c in one.items()}
    unknown = 1 - sum(word.values()) if n else 1.0
    seen, mass = Counter(), Counter()
    for (a, b), c in two.items():
        seen[a] += less(c, d2) / (total[a] + katz.PSEUDO)
        mass[a] += word[b]
    alpha = {a: (1 - seen[a]) / (1 - mass[a]) for a in total}

    def p(a, b):
        if two[a, b]:
            return less(two[a, b], d2) / (total[a] + katz.PSEUDO)
        return alpha.get(a, 1.0) * word.get(b, unknown)

    for a in list(total)[:40]:
        assert math.isclose(sum(p(a, b) for b in one) + alpha[a] * unknown, 1)
    out = []
    for (i, *_), w, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append(((i, h, len(w), sum(one[x] > 0 for x in w), n), base, sum(math.log10(p(a, b)) for a, b in zip(["\0start", *w], w))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "parts"), [(1 << 24, 1), (3000, 3)])
def test_katz(docs, rows, no_docs, clashing, bucket, parts):
    found = katz.fit_score(clashing, bucket_bytes=bucket, parts=parts).scores
    got = sorted(((tuple(r)[:5], r["base_score"], r["score"]) for r in found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    expected = katz_plain(rows)
    assert sorted((g[0] for g in got), key=repr) == sorted((e[0] for e in expected), key=repr)
    for k in (1, 2):
        a, b = (np.array(sorted(x[k] for x in y)) for y in (got, expected))
        assert np.allclose(a, b, rtol=1e-6, atol=1e-4), a - b  # sums of logarithms travel in single precision
    assert katz.fit_score(no_docs).scores.count() == 0


def test_katz_saved(spark, docs, rows, no_docs, clashing, tmp_path):
    model = katz.fit_score(docs, bucket_bytes=3000, parts=3)
    model.save(str(tmp_path / "model"))
    loaded = katz.Model.load(spark, str(tmp_path / "model"))
    assert (loaded.tokens, loaded.vocabulary, loaded.unknown, loaded.scores) == (model.tokens, model.vocabulary, model.unknown, None)
    got = sorted(map(tuple, loaded.score(clashing).collect()), key=lambda r: (repr(r[0]), r[1], r[2]))
    expected = sorted(((ints[0], ints[2], score) for ints, _, score in katz_plain(rows)), key=lambda r: (repr(r[0]), r[1], r[2]))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected], rtol=1e-9, atol=1e-9)
    assert loaded.score(no_docs).count() == 0
    other = spark.createDataFrame([(1, "never seen " * 3), (2, None)], "doc_id long, text string")
    again = {r["doc_id"]: r for r in loaded.score(other).collect()}
    assert again[1]["n_tokens"] == 7 and again[1]["score"] < 0 and again[2]["n_tokens"] == 1


def test_katz_untrained(spark):
    from pyspark.sql import functions as F

    own = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in katz.fit_score(own, held=F.lit(True)).scores.collect()}
    assert rows[1]["train_tokens"] == 0 and rows[1]["n_known"] == 0 and rows[1]["base_score"] == rows[1]["score"] == 0.0 and rows[2]["n_tokens"] == 1
    assert [r["score"] for r in katz.fit_score(own, held=F.lit(True)).score(own).collect()] == [0.0, 0.0]


def test_discounts():
    d = katz.discounts([1000, 300, 150, 90, 60, 45])
    assert len(d) == 5 and all(0 < x < 1 for x in d)
    assert katz.discounts([0, 0, 0, 0, 0, 0]) == [1 - 0.5 / r for r in range(1, 6)]


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline
    import __spark_entry__

    table = [r for r in rows if r[0] is not None][:-2]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(ALNUM.findall(lower(rows[3][1]))[4:24])), (2, "nothing of this stands anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "token_rows":
            assert sorted(docs.columns) == sorted(before.columns)
            kept[name] = {r["doc_id"] for r in docs.collect()}
    judged = {r[0]: len(SPACED.findall(r[1] or "")) for r in table}
    assert all(judged[i] >= 10 for i in kept["quality_rules"]) and 5 in kept["quality_rules"]
    left = [r for r in table if r[0] in kept["quality_rules"]]
    _, _, group = links(left)
    assert kept["near_duplicates"] == {min(left[j][0] for j in range(len(left)) if group[j] == g) for g in set(group)}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert len(ALNUM.findall(lower(text[3]))) == len(ALNUM.findall(lower(rows[3][1]))) - 20
    packed = unpacked(docs, packing.ROW_LENGTH)
    assert {d for d, *_ in packed} == kept["source_mix"]
    assert __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).agg({"n_used": "sum"}).head()[0] == docs.agg({"n_used": "sum"}).head()[0]


def test_pipeline_edges(spark, clashing, tmp_path):
    """Null and repeated ids, equal rows and clashing columns pass every stage; a second run gives the same documents; empty tables give none."""
    import corpus_pipeline

    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = []
    for turn, (own, empty) in enumerate(((clashing, False), (clashing.repartition(2), False), (clashing.filter("false"), True))):
        docs, kept = own, {}
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{turn}_{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{turn}_{name}"))
            if name != "token_rows":
                assert sorted(docs.columns) == sorted(own.columns)
                kept[name] = bag(docs, "doc_id", "text", "_h", "key")
        if empty:
            assert docs.count() == 0 and not any(kept.values())
            continue
        assert any(r[0] is None for r in kept["quality_rules"]) and kept["decontamination"] == kept["near_duplicates"]
        assert set(kept["near_duplicates"]) <= set(kept["quality_rules"]) and all(h == "?" for _, _, h, _ in kept["source_mix"])
        assert len({t for _, t, *_ in kept["near_duplicates"]}) == len(kept["near_duplicates"]) and {d for d, *_ in kept["source_mix"]} <= {d for d, *_ in kept["near_duplicates"]}
        seen.append(kept)
    assert seen[0] == seen[1]


def test_ngram_rings(spark):
    """Large groups: close sets are counted by sums, others compared, and the rows that leave stay in proportion to the group."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(150)]
    table = []
    for i in range(160):  # one to four words of a text changed, some changes shared
        own = list(words)
        for _ in range(1 + i % 4):
            own[int(rng.integers(0, 150))] = f"x{rng.integers(0, 4) if i % 3 else i}"
        table.append((i, " ".join(own[: 150 - (i % 5) * 7])))
    table += [(200 + i, table[i][1]) for i in range(0, 160, 9)] + [(None, table[4][1]), (None, table[5][1]), (None, table[5][1])]
    own = spark.createDataFrame(table, "doc_id long, text string")
    _, near, group = links(table)
    for block, grams in ((8, 1 << 20), (40, 3000)):
        found = ngram_join.join(own, block=block, block_grams=grams)
        assert bag(found, "doc_id", "n_links") == sorted(((r[0], sum(near[i]) - 1) for i, r in enumerate(table)), key=repr)
        assert {r["class_id"] for r in found.collect()} == {table[g][0] for g in set(group)}


def test_ngram_rows_are_linear(spark, monkeypatch):
    """2,000 near copies of a text leave the comparison with about a row each."""
    words = [f"w{i}" for i in range(120)]
    table = [(i, " ".join([*words[: i % 120], f"x{i}", *words[i % 120 + 1 :]])) for i in range(2000)]
    sizes, write = [], ngram_join.common.cut

    def counted(df, *a):
        out = write(df, *a)
        if "links" in out.columns or out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.common, "cut", counted)
    found = ngram_join.join(spark.createDataFrame(table, "doc_id long, text string"))
    assert {(r["class_id"], r["n_links"]) for r in found.collect()} == {(0, 1999)}
    assert sizes and max(sizes) <= 2.5 * 2000, sizes


def test_components(spark):
    import random

    from basewell.llm import graph

    rng = random.Random(4)
    for n, m in ((1, 1), (40, 30), (300, 290)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 9)]
        top = {x: x for e in edges for x in e}
        for _ in top:
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        got = {r["v"]: r["c"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: top[v] for e in edges if e[0] != e[1] for v in e}


def test_mixed_repeats(spark):
    """Rows of one id, text and source that differ elsewhere are mixed alike however they are dealt to tasks."""
    rows = [(i // 6, f"w{i // 6} of the text", "ab"[i // 6 % 2], f"n{i * 7 % 11}", {"k": i}) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string, more map<string,int>")
    one, two = (sorted((tuple(map(str, r)) for r in mixing.mixed(d, block_words=3, slots_per_shard=5).collect())) for d in (docs.repartition(1), docs.orderBy(docs.note.desc()).repartition(7)))
    assert one == two and len(one) > 30

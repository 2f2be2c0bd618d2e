"""Queries over the index without a cap: keys of any number of occurrences stay."""

from collections import Counter

from basewell.plans import catalogue

DNA = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
TURN = str.maketrans("ACGT", "TGCA")


def cores(text, k=27, c=11):
    seq = "".join(x for x in text.lower() if "a" <= x <= "z").translate(DNA)
    for i in range(len(seq) - k + 1):
        core = seq[i + 8 : i + 8 + c]
        yield i, min(core, core[::-1].translate(TURN))


def test_frequent_keys_stay(spark, tmp_path):
    text = "the quick brown fox jumps over a lazy dog and runs away"
    docs = [(i, text + " x" * (i % 3), "en", "s", 0) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    places = {}
    for i, t, *_ in docs:
        for at, core in cores(t):
            places.setdefault(core, []).append((i, at))
    expected = Counter((7, q, i, at) for q, core in cores(text) for i, at in places[core])
    found = catalogue.queries()["whole_all_matches"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in found.select("query_id", "qpos", "ref_id", "rpos").collect()) == expected
    assert max(map(len, places.values())) > catalogue.FULL.cap
    best = catalogue.queries()["whole_best_flex_match"](spark, str(tmp_path)).groupBy("qpos").count().collect()
    assert {r["qpos"] for r in best} == {q for q, _ in cores(text)} and all(r["count"] >= 90 for r in best)
    assert catalogue.queries()["whole_lookup_misses"](spark, str(tmp_path)).count() == 0


def test_build_steps_over_documents(spark, tmp_path):
    docs = [(1, "the quick brown fox jumps over a lazy dog " * 300), (2, "short"), (3, None), (4, "pack my box with five dozen liquor jugs now"), (5, "pack my box with five dozen liquor jugs now")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = sorted((i, at) for i, t in docs for at, _ in cores(t or ""))
    for name in ("core_flank_split", "canonical_core"):
        found = catalogue.queries()[f"indexed_{name}"](spark, str(tmp_path))
        assert sorted(map(tuple, found.select("ref_id", "pos").collect())) == expected
    sampled = catalogue.queries()["indexed_closed_syncmer_filter"](spark, str(tmp_path)).select("ref_id").distinct()
    assert {r["ref_id"] for r in sampled.collect()} == {1, 4, 5}


def test_point_lookup_moves_one_key(spark, tmp_path, monkeypatch):
    """Occurrences of other keys go where they are read: no join or shuffle has them."""
    docs = [(1, "the quick brown fox jumps over a lazy dog " * 30), (2, "acgtaccacac" * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plans = []
    monkeypatch.setattr(catalogue.store, "written", lambda df, f=catalogue.store.written: plans.append(df.coalesce(1)._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    monkeypatch.setattr(catalogue.store, "spread", lambda df: df)
    found = catalogue.queries()["whole_point_lookup"](spark, str(tmp_path))
    core = min(catalogue.LITERAL_CORE, catalogue.LITERAL_CORE[::-1].translate(TURN))
    assert sorted(map(tuple, found.select("ref_id", "pos").collect())) == [(i, at) for i, t in docs for at, c in cores(t) if c == core]
    assert plans and not any("Join" in x or "Aggregate" in x for x in plans)

"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import common, decontaminate, html, katz, lexical_search, licenses, lines, mixing, ngram_join, online_packing, packing, quality, spelling, suffix_dedup


def op9_quality_rules(spark, sf_dir):
    return quality.assess(common.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


def op1_token_packing(spark, sf_dir):
    return packing.pack(common.read(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.join(common.read(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return html.extract(common.read(spark, sf_dir, "pages"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(common.read(spark, sf_dir, "documents")).drop("blocks")


def op5_source_mixing(spark, sf_dir):
    return mixing.taken(common.read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("items")


def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.dedupe(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark, sf_dir):
    return lines.dedupe(common.read(spark, sf_dir, "documents"))


def op10_katz_scores(spark, sf_dir):
    return katz.fit_score(common.read(spark, sf_dir, "documents")).scores


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(common.read(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op13_online_packing(spark, sf_dir):
    return online_packing.pieces(online_packing.pack(common.read(spark, sf_dir, "documents")))


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_packing": op1_token_packing,
        "op2_ngram_join": op2_ngram_join,
        "op3_html_extraction": op3_html_extraction,
        "op4_license_scan": op4_license_scan,
        "op5_source_mixing": op5_source_mixing,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_katz_scores": op10_katz_scores,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_lexical_search": op12_lexical_search,
        "op13_online_packing": op13_online_packing,
    }


def oracle_sql():
    return {
        "op2_ngram_join": ngram_join.ORACLE_SQL,
        "op4_license_scan": licenses.oracle_sql(),
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op8_line_dedup": lines.ORACLE_SQL,
        "op9_quality_rules": quality.oracle_sql(),
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
    }

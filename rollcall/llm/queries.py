"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from rollcall.llm import attribution, bestfit, decontaminate, fingerprints, html, merkle, ngram_join, packing, pii, quality, substring, warc, whitening
from rollcall.llm.common import table

QUERIES = {
    "op1_pii": lambda spark, d: pii.op1_pii(table(spark, d, "documents")),
    "op2_packing": lambda spark, d: packing.op2_packing(table(spark, d, "documents")),
    "op3_token_counts": lambda spark, d: attribution.op3_token_counts(table(spark, d, "documents")),
    "op4_html_extraction": lambda spark, d: html.op4_html_extraction(table(spark, d, "pages")),
    "op5_warc": lambda spark, d: warc.op5_warc(table(spark, d, "pages")),
    "op6_ngram_jaccard_join": lambda spark, d: ngram_join.op6_ngram_jaccard_join(table(spark, d, "documents")),
    "op7_quality_classifier": lambda spark, d: quality.op7_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_benchmark_decontamination": lambda spark, d: decontaminate.op8_benchmark_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_document_fingerprints": lambda spark, d: fingerprints.op9_document_fingerprints(table(spark, d, "documents")),
    "op10_substring_dedup": lambda spark, d: substring.op10_substring_dedup(table(spark, d, "documents")),
    "op11_merkle_manifest": lambda spark, d: merkle.op11_merkle_manifest(table(spark, d, "documents")),
    "op12_embedding_whitening": lambda spark, d: whitening.op12_embedding_whitening(table(spark, d, "embeddings")),
    "op13_best_fit_packing": lambda spark, d: bestfit.op13_best_fit_packing(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {"op5_warc": warc.ORACLE, "op10_substring_dedup": substring.ORACLE, "op6_ngram_jaccard_join": ngram_join.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE, "op11_merkle_manifest": merkle.ORACLE}

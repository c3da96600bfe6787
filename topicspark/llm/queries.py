"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from topicspark.llm import bpe, jaccard_join, packing, pii, pivot_index, quality_classifier, quality_rules, sharding, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_embedding_near_dedup": pivot_index.query,
    "op3_bpe": bpe.query,
    "op4_toxicity": toxicity.query,
    "op5_ngram_jaccard_join": jaccard_join.query,
    "op6_quality_rules": quality_rules.query,
    "op7_best_fit_packing": packing.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_pii": pii.query,
    "op10_url_filters": url_filter.query,
}
SQL = {"op1_sharding": sharding.SQL, "op2_embedding_near_dedup": pivot_index.SQL, "op5_ngram_jaccard_join": jaccard_join.SQL}

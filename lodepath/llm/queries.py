"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lodepath.llm import exact_topk, filter_audit, hnsw, lm_score, mixing, ngram_join, packing, quality, range_join, surrogates, token_align, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_exact_topk": exact_topk.op4_exact_topk,
    "op5_hnsw": hnsw.op5_hnsw,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii_surrogates": surrogates.op8_pii_surrogates,
    "op9_packing": packing.op9_packing,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_token_alignment": token_align.op12_token_alignment,
    "op13_range_join": range_join.op13_range_join,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op4_exact_topk": exact_topk.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_range_join": range_join.ORACLE,
}

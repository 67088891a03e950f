"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import embeddings, interplay, jaccard, licenses, linededup, lm, mixing, packing, quality, resampling, secrets, tokencount, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_url_filters": urls.op12_url_filters,
    "op13_filter_interaction": interplay.op13_filter_interaction,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.op1_sql(),
    "op3_line_dedup": linededup.OP3_SQL,
    "op8_secret_scans": secrets.op8_sql(),
    "op9_ngram_jaccard_join": jaccard.OP9_SQL,
    "op10_embedding_near_dedup": embeddings.OP10_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_url_filters": urls.OP12_SQL,
    "op13_filter_interaction": interplay.OP13_SQL,
}

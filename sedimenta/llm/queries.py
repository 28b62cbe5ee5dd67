"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, doubling, jaccard_join, merkle, mil_quality, packing, periodic_runs, robust_outliers, run_index, secrets, style_tree, token_transducer, url_filter

QUERIES = {
    "op1_run_length_index": run_index.op1_run_length_index,
    "op2_attention_quality": mil_quality.op2_attention_quality,
    "op3_robust_outliers": robust_outliers.op3_robust_outliers,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_site_style_tree": style_tree.op5_site_style_tree,
    "op6_substring_dedup": doubling.op6_substring_dedup,
    "op7_minhash_containment": decontamination.op7_minhash_containment,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_token_counts": token_transducer.op12_token_counts,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {"op7_minhash_containment": decontamination.OP7_SQL, "op9_url_filters": url_filter.OP9_SQL, "op11_merkle_manifest": merkle.manifest_sql()}

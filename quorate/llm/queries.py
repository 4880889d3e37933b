"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quorate.llm import cover_tree_join, decontamination, importance, jaccard_join, language_id, mixing, prefix_trie, resharding, threshold_search, token_files, token_rollups, toxicity, url_filter

QUERIES = {
    "op1_resharding": resharding.query,
    "op2_language_id": language_id.query,
    "op3_token_rollups": token_rollups.query,
    "op4_toxicity": toxicity.query,
    "op5_token_files": token_files.query,
    "op6_decontamination": decontamination.query,
    "op7_mixing": mixing.query,
    "op8_url_filter": url_filter.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_cover_tree_join": cover_tree_join.query,
    "op11_threshold_search": threshold_search.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_importance": importance.query,
}
ORACLES = {
    "op6_decontamination": decontamination.SQL,
    "op7_mixing": mixing.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_cover_tree_join": cover_tree_join.SQL,
    "op11_threshold_search": threshold_search.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_importance": importance.SQL,
}

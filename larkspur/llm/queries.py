"""Queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, language, masked_lm, near_dup, packing, pieces, pii, prefix_trie, quality, repeats, shards, spelling, url_rules

QUERIES = {
    "op1_near_dedup": near_dup.op1_near_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_pii": pii.op5_pii,
    "op6_sharding": shards.op6_sharding,
    "op7_quality": quality.op7_quality,
    "op8_substring_dedup": repeats.op8_substring_dedup,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_masked_lm": masked_lm.op10_masked_lm,
    "op11_url_filters": url_rules.op11_url_filters,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op11_url_filters": url_rules.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}

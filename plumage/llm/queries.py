"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from plumage.llm import bpe, chat_format, exact_dedup, language_id, line_dedup, minhash, nearest, packing, prefix_trie, quality_classifier, quality_rules, resampling, substring_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_minhash": minhash.op3_minhash,
    "op4_bpe": bpe.op4_bpe,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_nearest_neighbours": nearest.op12_nearest_neighbours,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_nearest_neighbours": nearest.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}

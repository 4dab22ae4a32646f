"""The operators' queries by name, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from gapcube.llm import bpe, chat, exact, html, language_model, ordinal, packing, repeats, rules, search, simhash, toxicity, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_suffix_array_dedup": repeats.op7_suffix_array_dedup,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_classifier": ordinal.op10_quality_classifier,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_ranked_lexical_search": search.op12_ranked_lexical_search,
    "op13_lm_scoring": language_model.op13_lm_scoring,
}
ORACLES = {"op6_exact_dedup": exact.ORACLE, "op8_quality_rules": rules.ORACLE, "op12_ranked_lexical_search": search.ORACLE}

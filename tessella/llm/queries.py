"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessella.llm import bpe, chat, exact, langid, lm, neardup, ngramjoin, packing, prefixtrie, spelling, tokencount, topk, toxicity

QUERIES = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_embedding_near_dedup": neardup.op2_embedding_near_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_ngram_jaccard_join": ngramjoin.op10_ngram_jaccard_join,
    "op11_conversation_trie": prefixtrie.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_top_k": topk.op13_exact_top_k,
}

ORACLE_SQL = {"op3_chat_formatting": chat.SQL, "op4_exact_dedup": exact.SQL, "op11_conversation_trie": prefixtrie.SQL, "op12_spelling_variants": spelling.SQL, "op13_exact_top_k": topk.SQL}

"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tmengine.llm import bpe, chat, divergence, embeddings, fim, lm_score, packing, pii, quality_classifier, quality_rules, sharding, simhash, topk

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat_format": chat.op2_chat_format,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_pii": pii.op8_pii,
    "op9_hilbert_sharding": sharding.op9_hilbert_sharding,
    "op10_packing": packing.op10_packing,
    "op11_exact_topk": topk.op11_exact_topk,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_embedding_dedup": embeddings.OP7_SQL,
    "op11_exact_topk": topk.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}

"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from parkpulse.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    lm_scoring,
    pii,
    prefix_trie,
    resampling,
    token_counts,
    token_files,
    warc,
)


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_chat": chat.op2_chat,
        "op3_language_id": language_id.op3_language_id,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_token_files": token_files.op5_token_files,
        "op6_pii": pii.op6_pii,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_target_resampling": resampling.op13_target_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_chat": chat.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_target_resampling": resampling.SQL,
    }

"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, media, mixing, quality, rules, simhash, substring, suffixtree, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_quality_rules": rules.op4_quality_rules,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_mixing": mixing.op6_mixing,
        "op7_media_chunks": media.op7_media_chunks,
        "op8_suffix_tree_scoring": suffixtree.op8_suffix_tree_scoring,
        "op9_byte_level_bpe": bpe.op9_byte_level_bpe,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring.OP2_SQL, "op5_chat_formatting": chat.OP5_SQL}

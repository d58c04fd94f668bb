"""Queries of the training-data operators over whole tables, and the SQL that matches some of them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query name -> module that has the function of this name.
MODULES = {
    "op1_minimax_sharding": "sharding",
    "op2_pstable_embedding_dedup": "embedding_dedup",
    "op3_simhash_near_dedup": "simhash",
    "op4_pfair_mixing": "mixing",
    "op5_edit_join_line_dedup": "line_dedup",
    "op6_recurrent_html_extraction": "html_extract",
    "op7_chat_formatting": "chat",
    "op8_quality_rules": "quality_rules",
    "op9_difference_cover_dedup": "suffix_dedup",
    "op10_byte_bpe": "bpe",
    "op11_nearest_example_toxicity": "toxicity",
    "op12_chat_structure_repair": "chat_repair",
    "op13_hard_negative_mining": "hard_negatives",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {}

"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import importlib

#: Query name and module of each operator; modules are imported when the mapping is asked for.
OPERATORS = {
    "op1_html_extraction": "html",
    "op2_quality_rules": "quality",
    "op3_chat_rotation": "chat",
    "op4_license_scan": "licenses",
    "op5_pii": "pii",
    "op6_decontamination": "tiling",
    "op7_ngram_jaccard_join": "jaccard",
    "op8_byte_bpe": "bpe",
    "op9_ppm_scores": "ppm",
    "op10_substring_dedup": "passages",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    """op3 whole; the others have trained, hashed or many-rule columns that SQL can't give: tests/llm holds them against brute force."""
    from .chat import ORACLE

    return {"op3_chat_rotation": ORACLE}

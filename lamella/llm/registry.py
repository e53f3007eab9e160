"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module
NAMES = {
    "op1_mixing": "mixing",
    "op2_quality_rules": "quality",
    "op3_substring_dedup": "substrings",
    "op4_chat_formatting": "chat",
    "op5_near_duplicates": "near_duplicates",
    "op6_html_extraction": "html_text",
    "op7_personal_data": "personal_data",
    "op8_decontamination": "decontaminate",
    "op9_suffix_dedup": "suffixes",
    "op10_token_packing": "packing",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}

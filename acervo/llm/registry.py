"""Queries of this subpackage, with their SQL twins."""

from __future__ import annotations

import importlib

#: name: (module, SQL can express it)
OPERATORS = {
    "op1_winnowing": ("winnowing", False),
    "op2_byte_bpe": ("byte_bpe", False),
    "op3_quality_cotraining": ("cotraining", False),
    "op4_license_scan": ("license_scan", False),
    "op5_rule_ledger": ("rule_ledger", True),
    "op6_substring_dedup": ("substring_dedup", False),
    "op7_source_mixing": ("mixing", True),
    "op8_simhash": ("simhash", False),
    "op9_token_files": ("token_files", False),
    "op10_url_filter": ("url_filter", True),
}


def _module(name: str):
    return importlib.import_module(f"acervo.llm.{OPERATORS[name][0]}")


def queries() -> dict:
    return {name: _module(name).query for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name, (_, sql) in OPERATORS.items() if sql}

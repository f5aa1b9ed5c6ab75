"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` give what the registry adds when this subpackage is present.
"""

from __future__ import annotations

import importlib

#: name of the registered query -> module that defines ``query`` and, where SQL can express it, ``SQL``.
OPERATORS = {
    "op1_quality_rules": "quality_rules",
    "op2_quality_classifier": "quality_model",
    "op3_bpe_codec": "bpe",
    "op4_simhash_dedup": "simhash",
    "op5_packing": "packing",
    "op6_lm_scoring": "language_model",
    "op7_substring_dedup": "substring_dedup",
    "op8_language_id": "language_id",
    "op9_document_fingerprints": "imatch",
    "op10_license_scan": "license_scan",
    "op11_merkle_manifest": "merkle",
    "op12_toxicity": "toxicity",
    "op13_hard_negatives": "hard_negatives",
}


def _module(name: str):
    return importlib.import_module(f"factloom.llm.{OPERATORS[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in OPERATORS if (sql := getattr(_module(name), "SQL", None))}

"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

import importlib

#: query -> module; the function has the query's name.
MODULES = {
    "op1_sentencepiece": "pieces",
    "op2_language_id": "langid",
    "op3_decontamination": "decontam",
    "op4_token_counts": "token_counts",
    "op5_line_dedup": "line_dedup",
    "op6_lm_scoring": "ctw",
    "op7_exact_dedup": "exact_dedup",
    "op8_sharding": "sharding",
    "op9_minhash_dedup": "minhash",
    "op10_secret_scans": "secrets",
}


def queries() -> dict:
    import corpus_pipeline

    named = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)

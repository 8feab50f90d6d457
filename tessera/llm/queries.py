"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query -> module; each module has the query as a function, and ORACLE where SQL can express it.
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_bpe": "bpe",
    "op3_ngram_join": "ngram_join",
    "op4_exact_dedup": "exact_dedup",
    "op5_neighbours": "neighbours",
    "op6_toxicity": "toxicity",
    "op7_pii": "pii",
    "op8_packing": "packing",
    "op9_quality": "quality",
    "op10_url_filters": "url_filter",
}


def _module(name: str):
    return importlib.import_module(f"tessera.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}

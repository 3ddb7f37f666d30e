"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Module of each registered query; the modules hold operator, query and SQL together.
_MODULES = {
    "op1_lm_scoring": "lm_scoring",
    "op2_language_id": "language_id",
    "op3_toxicity": "toxicity",
    "op4_quality_rules": "quality_rules",
    "op5_sentencepiece": "sentencepiece_codec",
    "op6_simhash": "simhash",
    "op7_quality_classifier": "quality_classifier",
    "op8_token_counts": "token_counts",
    "op9_mixing": "mixing",
    "op10_topk_search": "bm25_search",
}


def _module(name: str):
    return importlib.import_module(f".{_MODULES[name]}", __package__)


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(_module(name), "ORACLE", None))}

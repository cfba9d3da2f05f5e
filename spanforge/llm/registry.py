"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

NAMES = ("decontaminate", "secret_scan", "html_extract", "sharding", "exact_topk", "quality_cnn", "near_dedup", "byte_bpe", "substring_dedup", "suffix_dedup", "collocations", "toxicity", "lexical_search")
MODULES = [import_module(f"spanforge.llm.{name}") for name in NAMES]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

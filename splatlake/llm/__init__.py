"""Operators for preparing language-model training data; nothing else in the library imports them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

OPERATORS = ["sharding", "warc", "vectors", "minhash", "quality_model", "quality_rules", "packing", "byte_bpe", "url_filter",
             "secret_scan", "source_audit", "prefix_trie", "maxent_lm"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (and its SQL twin) under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for name in OPERATORS:
        import_module(f"splatlake.llm.{name}")

"""Registered queries: one entry per operator, with the matching SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FAMILIES: list[str] = ["scalars", "labelling", "detections", "tracks", "masks", "selection", "objects", "support", "carving", "audit", "streams", "files"]


def query(name: str, sql: str | None = None):
    """Register a callable (and its SQL twin) under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for family in FAMILIES:
        import_module(f"splatlake.queries.{family}")

"""Queries of the dealt operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers a query."""
    from docloom.llm import (  # noqa: F401
        contamination,
        dialogue,
        html_text,
        langid,
        licenses,
        line_quality,
        merkle,
        packing,
        personal,
        quality_rules,
        sharding,
        simhash,
        warc,
    )

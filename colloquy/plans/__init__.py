"""Queries bound to the input tables."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans.registry import ORACLES, QUERIES


def _load() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    _load()
    return QUERIES["lib_search_stats"](spark, sf)

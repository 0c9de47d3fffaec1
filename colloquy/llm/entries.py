"""What the driver's entry file adds: the queries, their SQL, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from colloquy.llm import queries as _queries  # noqa: F401  registers the queries
from colloquy.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]

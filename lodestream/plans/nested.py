"""Queries over nested candidate payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.operators.shred import candidate_tables, named_evidence
from lodestream.session import table


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return named_evidence(table(s, d, "sft_candidates"))


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: candidate_tables(table(s, d, "sft_candidates"))[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found} | {f"p3_{n}": _flat(n) for n in ("records", "candidates", "evidence", "critical_ids")}


def oracle_sql() -> dict[str, str]:
    return {}

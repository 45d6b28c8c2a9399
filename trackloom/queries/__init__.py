"""Driver-facing queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.queries.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from trackloom.queries import audit, filters, forms, fragments, ledger, matchreport, more, players, reports, retrieval, tables, tracking  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["possession_spells"](spark, sf_dir)

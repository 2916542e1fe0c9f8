"""All registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import dialect, findings, grouped, layout, market, monitoring, retrieval, spans, stores, streams, text, workspace  # noqa: F401  they register their plans

FLAGSHIP = "f7_sentences"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(dialect.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(dialect.ORACLES)

"""Queries by name, with their SQL equivalents, and the tables they read.

Repeated rows of the driver tables differ in their arrival time only; ``SEG``, ``FRG``, ``LOG`` and
``ANN`` are the tables without them, in SQL, and the functions of those names the same in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.runtime import spread
from lectern.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEG = "(SELECT DISTINCT * EXCLUDE (arrived_at) FROM segments)"
FRG = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM fragments)"
LOG = "(SELECT DISTINCT * EXCLUDE (logged_at) FROM prediction_log)"
ANN = "(SELECT DISTINCT * FROM annotations)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests alone."""

    def add(f: Query) -> Query:
        nonlocal sql
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            for mark, view in (("{SEG}", SEG), ("{FRG}", FRG), ("{LOG}", LOG), ("{ANN}", ANN)):
                sql = sql.replace(mark, view)
            ORACLES[name] = sql
        return f

    return add


def _distinct(name: str, key: str, late: str | None):
    def read(spark: SparkSession, d: str, *columns: str) -> DataFrame:
        df = table(spark, d, name)
        if late:
            df = df.drop(late)
        if columns:
            df = df.select(key, *[c for c in columns if c != key])
        return df.dropDuplicates([key])

    return read


seg = _distinct("segments", "seg_id", "arrived_at")
frg = _distinct("fragments", "fragment_id", "ingested_at")
log = _distinct("prediction_log", "log_id", "logged_at")
ann = _distinct("annotations", "ann_id", None)


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) of all documents, spread for work on whole texts."""
    return spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module of queries and return what they registered."""
    from lectern.plans import aggregates, classify, joins, layout, metrics, projections, sampling, scalars, setops, sources, streams, windows  # noqa: F401

    return QUERIES, ORACLES

"""Registered queries and the SQL that checks them."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


THRESHOLD, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast a side of a join, if it is not marked, by its size as shuffled and not by an estimate.

    The estimate of a written or kept table is the size of its compressed columns, which may be a twentieth of its rows.
    """
    most = spark.conf.get(THRESHOLD)
    if most != "-1":
        spark.conf.set(MEASURED, most)
        spark.conf.set(THRESHOLD, "-1")


LIMIT, COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000


def compiled_methods(spark: SparkSession) -> None:
    """Keep generated methods to the size that HotSpot compiles (its fixed value; a longer one is interpreted for good).

    Aggregates and projections of the 82 features give longer ones; Spark then runs them as single operators.
    """
    if int(spark.conf.get(LIMIT)) > COMPILED:
        spark.conf.set(LIMIT, str(COMPILED))


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` and, where SQL can express it, the SQL for its rows."""

    def keep(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            measured_broadcasts(spark)
            compiled_methods(spark)
            return f(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep

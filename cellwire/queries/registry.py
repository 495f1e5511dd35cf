"""Query registry and the helpers that queries share."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
SHIFT = 1.37e-10


def query(name: str, sql: str | None = None):
    """Register ``function(spark, folder) -> DataFrame`` and, where given, its check."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Round to six digits; sums of doubles depend on their order beyond that.

    The tiny shift keeps decimal ties such as 0.0000005 away from the rounding edge.
    """
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(SHIFT), 6) + F.lit(0.0) for c in columns})


def q6(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + {SHIFT}, 6) + 0.0)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(dict.fromkeys(parts)) + "\n"

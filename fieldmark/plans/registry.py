"""Where queries and their SQL are registered, and what both sides share."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: sums in another order differ in the last bits. Minus zero is zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0::DOUBLE AS {name}"

"""Registering queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry():
    """(queries, oracles, decorator): the decorator takes the SQL and registers under the function's name."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

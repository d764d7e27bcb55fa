"""Names of helper columns that a caller's table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that no column of ``df`` has, whatever its case: the name itself, or with
    underscores behind it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

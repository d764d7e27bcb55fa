"""Running sums, positions and ranks over groups of any size, in two steps, and ordered folds.

Rows are dealt to ranges of a sort key; the ranges' sums, of which there are few, give what is ahead of
each range, and a window gives what is ahead within it. No group is sorted in one task, however large. Only ``folded``, for
what needs the row before, goes through a group in one task; it holds one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brightloom.functions.names import free
from brightloom.session import share_package

PARTS = 64


def key_range(df: DataFrame, key: Column, parts: int = PARTS) -> Column:
    """The range of a numeric key (any type that casts to double): how many of at most ``parts`` - 1
    approximate quantiles are below it. Null is in the first range, like the least keys."""
    x = key.cast("double")
    cuts = df.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 50 * parts)).first()[0]
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < x))


def hash_range(number: Column, bits: int, parts: int = PARTS) -> Column:
    """The range of a number that is uniform over ``bits`` bits; no quantiles are needed."""
    return F.floor(number / F.lit(float(1 << bits)) * parts).cast("int")


def with_ahead(df: DataFrame, by: list[str], in_range: Column, order: list[Column | str], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with, for each (name, amount), the sum ``name`` of the amounts of the rows before a row in
    its group; ``order`` must agree with the ranges. Ties in it fall in any order."""
    place, at = free(df, "_range", "_at")
    keys, sums_of, totals = (free(df, *[f"_{kind}_{c}" for c in names]) for kind, names in (("by", by), ("sum", amounts), ("ahead", amounts)))
    ranged = df.withColumn(place, in_range)
    sums = ranged.groupBy(*by, place).agg(*[F.sum(a).alias(s) for a, s in zip(amounts.values(), sums_of, strict=True)])
    ahead = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(place).alias(at), *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(t) for s, t in zip(sums_of, totals, strict=True)])
    on = F.col(place) == F.col(at)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    within = Window.partitionBy(*by, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(sums, on)
    for (name, amount), t in zip(amounts.items(), totals, strict=True):
        out = out.withColumn(name, F.col(t) + F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return out.drop(place, at, *keys, *totals)


def mean_ranks(counted: DataFrame, value: str, n: str = "n") -> DataFrame:
    """``counted`` (one row for each distinct numeric ``value``, with its count) with mean_rank: ranks from
    1 over all rows counted, ties at their mean."""
    (before,) = free(counted, "_before")
    placed = with_ahead(counted, [], key_range(counted, F.col(value)), [value], {before: F.col(n)})
    return placed.withColumn("mean_rank", F.col(before) + (F.col(n) + 1) / 2.0).drop(before)


# The types of what a fold can find.
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def folded(rows: DataFrame, by: list[str], order: list[str], keeps: list[str], reads: list[Column], start: Callable[[], Any], step: Callable, found: str) -> DataFrame:
    """The columns ``keeps`` of ``rows``, and those of ``found`` (a schema of strings, longs and booleans) that an
    ordered fold gives to each: ``step`` takes the group's state before a row (``start`` before the first one) and
    the row's values of ``reads``, and returns the state after it and the values of ``found``. Groups of ``by`` are
    read in order of ``order``, one row after another, so that time grows with the rows and only one state stays in
    memory, however long a group is."""
    share_package(rows.sparkSession)
    added = T.StructType.fromDDL(found)
    kinds = [_ARROW[f.dataType.simpleString()] for f in added.fields]
    names = free(rows, *[f"_by_{c}" for c in by], *[f"_read_{k}" for k in range(len(reads))])
    n = len(by)
    placed = rows.repartition(*by).sortWithinPartitions(*by, *order)
    asked = placed.select(*keeps, *[F.col(c).cast("string").cast("binary").alias(k) for c, k in zip(by, names[:n], strict=True)], *[c.alias(k) for c, k in zip(reads, names[n:], strict=True)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            told = []
            for values in zip(*[batch.column(k).to_pylist() for k in names], strict=True):
                if values[:n] != group:
                    group, state = values[:n], start()
                state, out = step(state, *values[n:])
                told.append(out)
            new = [pa.array(column, kind) for column, kind in zip(zip(*told, strict=True), kinds, strict=True)] if told else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keeps], *new], names=[*keeps, *added.names])

    return asked.mapInArrow(fold, T.StructType([*[rows.schema[c] for c in keeps], *added.fields]))

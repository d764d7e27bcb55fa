"""Matches of an expression with their places in the text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.names import free

_BLOCK = 256


def sums_before(numbers: Column) -> Column:
    """For each integer of an array (not empty) the sum of those before it. Blocks are summed first, so
    that long arrays are not copied once for each element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)))

    def running(values: Column, first: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(first.alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
            lambda a: a["all"],
        )

    starts = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, running))


def with_matches(df: DataFrame, text: str, pattern: str, some: Column, into: str) -> DataFrame:
    """``df`` with ``into``: (text, start, end) of every match of ``pattern``, in code points, end
    exclusive; empty where ``some``, a cheap necessary condition, does not hold."""
    hits, gaps, steps, ahead = free(df, "_hits", "_gaps", "_steps", "_ahead")
    out = df.withColumn(hits, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    out = out.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))
    out = out.withColumn(steps, F.when(F.size(hits) > 0, F.transform(hits, lambda m, i: F.struct(m.alias("text"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))))
    out = out.withColumn(ahead, F.when(F.size(steps) > 0, sums_before(F.transform(steps, lambda s: s["gap"] + s["size"]))))
    placed = F.zip_with(steps, ahead, lambda s, a: F.struct(s["text"].alias("text"), (a + s["gap"]).alias("start"), (a + s["gap"] + s["size"]).alias("end")))
    return out.withColumn(into, F.coalesce(placed, F.array().cast("array<struct<text:string,start:int,end:int>>"))).drop(hits, gaps, steps, ahead)

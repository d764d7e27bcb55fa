"""Connected components of a large graph, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: longs); label is the least node of its
    component. Large-star and small-star steps in turn, each written to the shared scratch folder (its
    paths are added to ``scratch``), until the edges are stars and stay so."""
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch)
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = _least(down)
        stars = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            scratch,
        )
        now = stars.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

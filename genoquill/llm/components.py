"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _fold(e: DataFrame):
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of edges, root being the smallest node of its component.

    Nulls and self-loops are ignored, repeated edges count once; no edges give an empty result. Each round writes its
    edges to the shared folder; a round holds two aggregations with map-side minima, so a hub of any degree is fine.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = materialize(e, "edges")
    was = _fold(e)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _fold(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

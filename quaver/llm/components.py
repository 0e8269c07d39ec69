"""Connected components by alternating large and small stars, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node long, root long) of every node of edges (a long, b long); root is the smallest node reachable.

    Each round replaces the links by a smaller set with the same components (a large star, then a small star) and
    writes it to the shared folder; it ends when every link leads from a leaf to its root. The number of rounds grows
    with the logarithm of the longest path. Minima are aggregated map-side before the shuffle, and the joins back to the
    links are plain sort-merge joins, whose large partitions adaptive execution splits, so a node with very many links
    is no bottleneck. Self-links and repeated links are allowed; no links give an empty result.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        if not _unfinished(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(links)
        links = new
    raise RuntimeError(f"components need more than {max_rounds} rounds")


def _unfinished(links: DataFrame) -> bool:
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("v", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(seen.where("up > 1 or (up > 0 and down > 0)").limit(1).count())

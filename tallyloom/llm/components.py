"""Connected components of an edge table, by alternating large and small stars.

Every node learns the smallest node it can reach. A round is two aggregations and two
joins on the edges, which shrink towards stars; the number of rounds is logarithmic in
practice. Minima are taken with map-side combining and joined back, so a node with very
many neighbours is never gathered in one place; an equi-join on it may be split by
adaptive execution. Each round is written to the shared checkpoint folder, so that a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    )


def _star(pairs: DataFrame, least: DataFrame, keep_self: bool) -> DataFrame:
    """(v, least of u's neighbourhood) for each pair (u, v)."""
    moved = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_self:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of type long).

    ``component`` is the smallest node that can be reached. Loops and repeated edges are
    allowed, edges with a NULL end are ignored; an empty table has no components.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    loops = clean.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = cut_lineage(
        clean.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        digest = _digest(now)
        if digest == before or digest[0] == 0:
            break
        before = digest
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut_lineage(_star(both.filter(F.col("v") > F.col("u")), least, keep_self=False))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        below = down.groupBy("u").agg(F.min("v").alias("m"))
        now = cut_lineage(_star(down, below, keep_self=True))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.distinct().join(named.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return named.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))

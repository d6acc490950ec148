"""What every step of a long sequence starts from, worked out in a balanced tree.

Each node of a sequence turns a state (a whole number) into the next one. If two effects in
a row can be written as one effect, the nodes need not be passed one after the other:
``fan`` neighbours are composed into one node, again and again until a sequence has no more
than that; then states are handed down the same way. No group has more than ``fan`` rows,
the number of passes is logarithmic, and sequences of very different lengths share them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

FAN = 64


def numbered_runs(runs: DataFrame) -> DataFrame:
    """``runs`` (key, part, k, ...) with ``place``: 0, 1, ... per key in the order of (part, k).

    ``part`` is a partition of a sort by key, ``k`` grows from 0 by one inside a partition
    and key. Only one count per key and partition is put in order. ``runs`` are written
    first: computed twice, a range sort may cut its partitions at other rows.
    """
    runs = cut_lineage(runs)
    sizes = runs.groupBy("key", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # Written, so that its size is known and the runs themselves need not be shuffled.
    starts = cut_lineage(sizes.select("key", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return runs.join(starts, ["key", "part"]).withColumn("place", F.col("_start") + F.col("k")).drop("_start", "part", "k")


def exclusive_scan(
    nodes: DataFrame,
    starts: DataFrame,
    compose: Callable[[Sequence[bytes]], bytes],
    act: Callable[[bytes, int], int],
    fan: int = FAN,
) -> DataFrame:
    """(key, place, state): the state that each node finds.

    ``nodes`` has key, place (0, 1, ... per key) and effect (binary), ``starts`` one row per
    key with the state that its first node finds. ``compose`` makes one effect of several in
    order, ``act(effect, state)`` is the state after it.
    """
    levels = [cut_lineage(nodes.select("key", "place", "effect"))]
    longest = levels[0].agg(F.max("place")).first()[0]
    while longest is not None and longest >= fan:
        parents = levels[-1].withColumn("parent", F.floor(F.col("place") / fan)).groupBy("key", "parent")
        levels.append(cut_lineage(parents.applyInPandas(_composed(compose), "key long, place long, effect binary")))
        longest //= fan
    found = starts.select("key", F.lit(0).cast("long").alias("parent"), F.col("state").cast("long").alias("state"))
    for level in reversed(levels):
        below = level.withColumn("parent", F.floor(F.col("place") / fan)).join(found, ["key", "parent"])
        states = below.groupBy("key", "parent").applyInPandas(_handed_down(act), "key long, place long, state long")
        found = cut_lineage(states).select("key", F.col("place").alias("parent"), "state")
    return found.withColumnRenamed("parent", "place")


def _composed(compose: Callable[[Sequence[bytes]], bytes]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(children: pd.DataFrame) -> pd.DataFrame:
        effects = children.sort_values("place")["effect"].tolist()
        return pd.DataFrame({"key": children["key"].iloc[:1], "place": children["parent"].iloc[:1], "effect": [compose(effects)]})

    return one


def _handed_down(act: Callable[[bytes, int], int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def hand_down(children: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("place")
        state, states = int(children["state"].iloc[0]), []
        for effect in children["effect"]:
            states.append(state)
            state = act(effect, state)
        return children[["key", "place"]].assign(state=states)

    return hand_down

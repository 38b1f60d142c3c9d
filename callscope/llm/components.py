"""Connected components of a graph given as edges, by alternating large and small stars.

Both steps are aggregates and joins; no node's neighbours are gathered in one place. Edges are
written to the shared folder after each round, so plans stay short and a lost executor costs a
re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import discard, store

MAX_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but roots; ``edges`` has the long columns a and b.

    The root is the smallest node of the component. Loops, repeated and reversed edges are fine;
    an empty table gives an empty table.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = store(now, "edges")
    before = _print(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(small.union(own.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        now, last, before = after, before, _print(after)
        if before == last:
            break
    else:
        raise RuntimeError(f"no stable components after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

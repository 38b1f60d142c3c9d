"""Overlap of call sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a set holding more than this share of the union makes a Venn picture useless.
DEGENERATE_SHARE = 0.98


def call_masks(scored: DataFrame, tools: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row per called key with a bit mask of the tools calling it."""
    bit = F.lit(0)
    for i, tool in enumerate(tools):
        bit = F.when(F.col("tool") == tool, F.lit(1 << i)).otherwise(bit)
    return (
        scored.filter((F.col("prob") >= threshold) & F.col("tool").isin(list(tools)))
        .groupBy("key")
        .agg(F.bit_or(bit).alias("mask"))
    )


def overlap_regions(scored: DataFrame, tools: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Keys per combination of tools, for any number of tools: ``mask, tools, keys``."""
    names = F.array_compact(
        F.array(
            *[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(tool)) for i, tool in enumerate(tools)]
        )
    )
    return (
        call_masks(scored, tools, threshold)
        .groupBy("mask")
        .agg(F.count(F.lit(1)).alias("keys"))
        .select("mask", F.array_join(names, "&").alias("tools"), "keys")
    )


def overlap_counts(scored: DataFrame, tools: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The seven regions of three call sets, their union and whether a Venn picture makes sense."""
    a, b, c = tools
    mask = F.col("mask")

    def keys(value: int):
        return F.count_if(mask == value)

    def size(i: int):
        return F.count_if(mask.bitwiseAND(F.lit(1 << i)) > 0)

    counts = call_masks(scored, tools, threshold).agg(
        keys(1).alias(f"{a}_only"),
        keys(2).alias(f"{b}_only"),
        keys(4).alias(f"{c}_only"),
        keys(3).alias(f"{a}_and_{b}_only"),
        keys(5).alias(f"{a}_and_{c}_only"),
        keys(6).alias(f"{b}_and_{c}_only"),
        keys(7).alias("all_three"),
        F.count(F.lit(1)).alias("any_tool"),
        *[size(i).alias(f"_s{i}") for i in range(3)],
    )
    sizes = [F.col(f"_s{i}") for i in range(3)]
    filled = sum((s > 0).cast("int") for s in sizes)
    largest = F.greatest(*sizes)
    lopsided = largest / F.greatest(F.col("any_tool"), F.lit(1)) > DEGENERATE_SHARE
    return counts.withColumn("degenerate", (filled < 2) | lopsided).drop("_s0", "_s1", "_s2")

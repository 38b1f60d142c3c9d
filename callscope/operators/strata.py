"""Metrics inside strata of allele fraction and read depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.numeric import DEPTH_LABELS, fixed_bin, right_closed_bin
from callscope.operators import curves
from callscope.operators.align import first_per_key
from callscope.operators.ordered import Cut, histogram, quantiles, uncut

# Quantiles of the depth tertiles, widening of tied edges.
TERTILES = (1 / 3, 2 / 3)
EDGE_BUMP = 1e-9
EDGES = ("lowest", "t1", "t2", "highest")


def consolidate_annotations(sources: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """``key, vaf_est, depth_est``: the first row per key over sources in their order of priority.

    The first row counts even if its values are missing. ``order`` names the columns that decide
    inside one source.
    """
    stacked = None
    for rank, source in enumerate(sources):
        ranked = source.withColumn("src_rank", F.lit(rank))
        stacked = ranked if stacked is None else stacked.unionByName(ranked)
    return first_per_key(stacked, ["key"], ["src_rank", *order]).select("key", "vaf_est", "depth_est")


def tertile_edges(rows: DataFrame, value: str, cut: Cut = uncut) -> DataFrame:
    """One row ``lowest, t1, t2, highest``; a tied edge moves up by 1e-9."""
    edges = quantiles(cut(histogram(rows.select(value), [], value)), [], value, TERTILES, ("t1", "t2"))
    for below, name in zip(EDGES, EDGES[1:]):
        bumped = F.when(F.col(name) <= F.col(below), F.col(below) + EDGE_BUMP).otherwise(F.col(name))
        edges = edges.withColumn(name, bumped)
    return edges.select(*EDGES)


def depth_tertile(rows: DataFrame, value: str, over: DataFrame | None = None, cut: Cut = uncut) -> DataFrame:
    """Add ``depth_bin`` (low, med, high), right-closed; edges come from ``over`` if given."""
    edges = tertile_edges(rows if over is None else over, value, cut)
    edged = rows.withColumn("_edges", edges.select(F.struct(*EDGES)).scalar())
    bins = right_closed_bin(value, [F.col("_edges")[name] for name in EDGES], DEPTH_LABELS)
    return edged.withColumn("depth_bin", bins).drop("_edges")


STRATUM = ["tool", "stratum", "bin"]


def stratified_curve(
    scored: DataFrame, annotations: DataFrame, reference: bool = False, cut: Cut = uncut
) -> DataFrame:
    """The curve of every tool inside each allele-fraction bin and depth tertile.

    Depth tertiles come from distinct keys; ``reference=True`` takes them from the joined rows,
    in which a key counts once per tool.
    """
    noted = annotations.select("key", "vaf_est", "depth_est")
    joined = scored.join(noted, "key", "left")
    # The edges need the annotated keys only, not the rows of all tools.
    over = joined if reference else noted.join(scored.select("key").distinct(), "key", "left_semi")
    binned = depth_tertile(joined, "depth_est", over, cut).withColumn("vaf_bin", fixed_bin("vaf_est"))
    strata = F.array(
        F.struct(F.lit("vaf").alias("stratum"), F.col("vaf_bin").alias("bin")),
        F.struct(F.lit("depth").alias("stratum"), F.col("depth_bin").alias("bin")),
    )
    rows = binned.select("tool", "label", "prob", F.inline(strata)).filter(F.col("bin").isNotNull())
    return curves.scored_curve(rows, STRATUM, cut)


def stratified_areas(
    scored: DataFrame, annotations: DataFrame, reference: bool = False, cut: Cut = uncut
) -> DataFrame:
    """AUPRC and AUROC per tool and stratum; strata that lack a class are left out."""
    return (
        stratified_curve(scored, annotations, reference, cut)
        .groupBy(*STRATUM)
        .agg(
            F.max("p").alias("positives"),
            F.max("n").alias("negatives"),
            curves.auroc().alias("auroc"),
            curves.auprc().alias("auprc"),
        )
        .filter((F.col("positives") > 0) & (F.col("negatives") > 0))
    )


def stratified_pr_points(
    scored: DataFrame, annotations: DataFrame, reference: bool = False, cut: Cut = uncut
) -> DataFrame:
    """The precision-recall points behind ``stratified_areas``."""
    return curves.pr_points(stratified_curve(scored, annotations, reference, cut), STRATUM)

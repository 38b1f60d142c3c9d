"""Score distributions and calibration: the tables behind the usual pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.curves import score_counts
from callscope.operators.ordered import Cut, histogram, quantiles, rank_position, running_totals, uncut

# Calibration bins, whisker reach in interquartile ranges.
CALIBRATION_BINS = 10
WHISKER = 1.5


def calibration(
    scored: DataFrame, group: Sequence[str] = ("tool",), bins: int = CALIBRATION_BINS, cut: Cut = uncut
) -> DataFrame:
    """Mean score and observed positive rate in quantile bins; empty bins give no row.

    A score belongs to bin j if exactly j inner quantiles lie below it. The quantile at rank r
    lies below a score exactly if more than floor(r) rows score lower, so the running row count
    decides and the quantiles themselves are never computed or joined.
    """
    counts = cut(score_counts(scored, group)).withColumn("rows", F.col("pos") + F.col("neg"))
    ranked = running_totals(counts, group, "score", ["rows", "pos"])
    lower_rows = F.col("rows_cum") - F.col("rows")
    below = [
        (lower_rows > F.floor(rank_position(j / bins, "rows_all"))).cast("int") for j in range(1, bins)
    ]
    return (
        ranked.withColumn("bin", sum(below[1:], below[0]))
        .groupBy(*group, "bin")
        .agg(
            F.sum("rows").alias("n_rows"),
            (F.sum(F.col("score") * F.col("rows")) / F.sum("rows")).alias("mean_score"),
            (F.sum("pos").cast("double") / F.sum("rows")).alias("positive_rate"),
        )
    )


def score_summary(
    scored: DataFrame, group: Sequence[str] = ("tool", "label"), cut: Cut = uncut
) -> DataFrame:
    """Quartiles, mean, range and whiskers (last score within 1.5 IQR) per tool and label."""
    group = list(group)
    counts = cut(histogram(scored.filter(F.col("label").isNotNull()), group, "prob"))
    box = quantiles(counts, group, "prob", (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    score = F.col("prob")
    # One row per group: read as one map from a scalar subquery, so that no row moves to meet its box.
    named = F.struct(*[F.col(name) for name in group])
    entries = F.struct(named, F.struct(*[F.col(c) for c in box.columns if c not in group]))
    boxes = box.agg(F.map_from_entries(F.collect_list(entries))).scalar()
    return (
        counts.withColumnRenamed("n", "_rows")
        .withColumn("_box", boxes[named])
        .select(*group, "prob", "_rows", "_box.*")
        .groupBy(*group)
        .agg(
            F.max("n").alias("n_rows"),
            (F.sum(score * F.col("_rows")) / F.sum("_rows")).alias("mean"),
            F.max("lowest").alias("lowest"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.max("highest").alias("highest"),
            F.min(F.when(score >= F.col("q1") - reach, score)).alias("whisker_low"),
            F.max(F.when(score <= F.col("q3") + reach, score)).alias("whisker_high"),
        )
    )


def score_histogram(scored: DataFrame, bins: int = 20, group: Sequence[str] = ("tool", "label")) -> DataFrame:
    """Rows and density per equal-width score bin on [0, 1]; 1.0 falls into the last bin."""
    cell = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).cast("int")
    cells = (
        scored.filter(F.col("prob").isNotNull() & F.col("label").isNotNull())
        .groupBy(*group, cell.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    total = F.sum("n_rows").over(Window.partitionBy(*group))
    return cells.withColumn("density", F.col("n_rows") * float(bins) / total)

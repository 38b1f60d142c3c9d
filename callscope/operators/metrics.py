"""Counts and metrics at a threshold, and the metric table of a comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.numeric import hard_call, ratio_or_zero
from callscope.operators import curves
from callscope.operators.ordered import Cut, uncut


def class_counts(scored: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Rows, positives, negatives, rows without a label and the positive rate."""
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )


def hard_calls(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """Add the 0/1 call ``pred``."""
    return scored.withColumn("pred", hard_call("prob", threshold))


def _counts(threshold: float) -> list[Column]:
    called = F.col("prob") >= threshold
    positive, negative = F.col("label") == 1, F.col("label") == 0
    return [
        F.count_if(positive & called).alias("tp"),
        F.count_if(negative & called).alias("fp"),
        F.count_if(negative & ~called).alias("tn"),
        F.count_if(positive & ~called).alias("fn"),
    ]


def confusion_counts(scored: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("tool",)) -> DataFrame:
    return scored.groupBy(*group).agg(*_counts(threshold))


def rates() -> dict[str, Column]:
    """Rates from ``tp, fp, tn, fn``; 0 on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio_or_zero(tn, tn + fp),
        "accuracy": ratio_or_zero(tp + tn, tp + fp + tn + fn),
    }


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("tool",)) -> DataFrame:
    counts = confusion_counts(scored, threshold, group)
    return counts.select(*group, "tp", "fp", "tn", "fn", *[c.alias(k) for k, c in rates().items()])


def class_report(scored: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Precision, recall, F1 and support of both classes, their plain and weighted mean, and accuracy."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn

    def one(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [
            ratio_or_zero(hit, hit + wrong),
            ratio_or_zero(hit, hit + missed),
            ratio_or_zero(2 * hit, 2 * hit + wrong + missed),
        ]

    def row(name: str, values: Sequence[Column], support: Column) -> Column:
        names = ("precision", "recall", "f1")
        return F.struct(
            F.lit(name).alias("class"),
            *[v.cast("double").alias(n) for n, v in zip(names, values)],
            support.cast("bigint").alias("support"),
        )

    negative, positive = one(tn, fn, fp), one(tp, fp, fn)
    n, p = tn + fp, tp + fn
    plain = [(a + b) / 2 for a, b in zip(negative, positive)]
    weighted = [ratio_or_zero(a * n + b * p, total) for a, b in zip(negative, positive)]
    accuracy = ratio_or_zero(tp + tn, total)
    rows = F.array(
        row("0", negative, n),
        row("1", positive, p),
        row("macro avg", plain, total),
        row("weighted avg", weighted, total),
        row("accuracy", [accuracy] * 3, total),
    )
    return confusion_counts(scored, threshold, group).select(*group, F.inline(rows))


def confusion_normalised(
    scored: DataFrame, threshold: float | Column = 0.5, group: Sequence[str] = ("tool",)
) -> DataFrame:
    """Cells of the confusion matrix with their share of the true class."""
    cells = (
        hard_calls(scored.filter(F.col("label").isin(0, 1)), threshold)
        .groupBy(*group, "label", "pred")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    of_class = Window.partitionBy(*group, "label")
    return cells.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(of_class))


def brier(scored: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Mean squared distance of score and label."""
    gap = F.col("prob").cast("double") - F.col("label").cast("double")
    return scored.groupBy(*group).agg(F.avg(gap * gap).alias("brier"))


def metrics_from_curve(
    points: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("tool",), single_class: str = "null"
) -> DataFrame:
    """The ten metrics of the comparison table, from one aggregate over the curve.

    A group with one class keeps its row. ``single_class='null'`` empties every metric but the
    row count and the positive rate; ``'zeros'`` reports 0 for the threshold metrics, and
    specificity 1 where only negatives exist.
    """
    called = F.col("score") >= threshold
    zero = F.lit(0).cast("bigint")
    table = points.groupBy(*group).agg(
        curves.auroc().alias("auroc"),
        curves.auprc().alias("auprc"),
        curves.best_precision().alias("prec_at_r95"),
        curves.best_recall().alias("rec_at_p90"),
        F.sum(F.when(called, F.col("pos")).otherwise(zero)).alias("tp"),
        F.sum(F.when(called, F.col("neg")).otherwise(zero)).alias("fp"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
    )
    table = table.withColumns({"tn": F.col("n") - F.col("fp"), "fn": F.col("p") - F.col("tp")})
    both = (F.col("p") > 0) & (F.col("n") > 0)
    columns = []
    for name, value in rates().items():
        if single_class == "null":
            alone = F.lit(None).cast("double")
        elif single_class == "zeros":
            alone = F.when((F.col("n") > 0) & F.lit(name == "specificity"), F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            raise ValueError("single_class must be null or zeros")
        columns.append(F.when(both, value).otherwise(alone).alias(name))
    by_name = dict(zip(rates(), columns))
    rows = F.col("p") + F.col("n")
    return table.select(
        *group,
        "auroc",
        "auprc",
        by_name["f1"],
        by_name["precision"],
        by_name["recall"],
        by_name["specificity"],
        "prec_at_r95",
        "rec_at_p90",
        rows.alias("n_rows"),
        F.try_divide(F.col("p").cast("double"), rows).alias("positive_rate"),
    )


def metrics_table(
    scored: DataFrame,
    threshold: float = 0.5,
    group: Sequence[str] = ("tool",),
    single_class: str = "null",
    cut: Cut = uncut,
) -> DataFrame:
    """One row per tool with all metrics."""
    return metrics_from_curve(curves.scored_curve(scored, group, cut), threshold, group, single_class)


def class_sizes(rows: DataFrame, group: Sequence[str] = (), label: str = "label") -> Column:
    """``n0`` and ``n1`` of a row's group, from one scalar subquery that holds a map over groups."""
    named = F.struct(F.lit(0).alias("_"), *[F.col(name) for name in group])
    counted = rows.groupBy(named.alias("_g")).agg(
        F.struct(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).alias("_n")
    )
    return counted.agg(F.map_from_entries(F.collect_list(F.struct("_g", "_n")))).scalar()[named]


def class_weights(
    rows: DataFrame, label: str = "label", weight: str = "weight", group: Sequence[str] = ()
) -> DataFrame:
    """Weight every row by 1 / rows of its class in its group."""
    own = F.when(F.col(label) == 1, F.col("_counts.n1")).otherwise(F.col("_counts.n0"))
    weighted = rows.withColumn("_counts", class_sizes(rows, group, label))
    return weighted.withColumn(weight, 1.0 / F.greatest(own, F.lit(1)).cast("double")).drop("_counts")

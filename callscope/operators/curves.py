"""Curves, areas, operating points and threshold choice from one score histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.numeric import ratio_or_zero
from callscope.operators.ordered import Cut, running_totals, uncut

# Default targets, threshold grids.
RECALL_TARGET = 0.95
PRECISION_TARGET = 0.90
OPERATING_SETTINGS = (("Recall", 0.95), ("Precision", 0.98), ("Precision", 0.90))
SWEEP_STEPS = 200
F1_GRID_PERCENT = tuple(range(5, 100, 5))
DEFAULT_THRESHOLD = 0.5


def score_counts(scored: DataFrame, group: Sequence[str] = ("tool",), weight: str | None = None) -> DataFrame:
    """Positives and negatives at every distinct score: ``<group>, score, pos, neg``.

    Rows with no label or no score are left out. Equal scores merge inside each task before the
    shuffle, which also disposes of the one value (0 after alignment) most rows share.
    """
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    zero = F.lit(0).cast("bigint")
    score = F.col("prob").cast("double")
    return (
        scored.filter(F.col("label").isin(0, 1) & score.isNotNull() & ~F.isnan(score))
        .groupBy(*group, score.alias("score"))
        .agg(
            F.sum(F.when(F.col("label") == 1, one).otherwise(zero)).alias("pos"),
            F.sum(F.when(F.col("label") == 0, one).otherwise(zero)).alias("neg"),
        )
    )


def curve(counts: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Counts of ``score >= s`` at every distinct score s: adds ``tp, fp, p, n``."""
    totals = running_totals(counts, group, "score", ["pos", "neg"], descending=True)
    return totals.select(
        *group,
        "score",
        "pos",
        "neg",
        F.col("pos_cum").alias("tp"),
        F.col("neg_cum").alias("fp"),
        F.col("pos_all").alias("p"),
        F.col("neg_all").alias("n"),
    )


def scored_curve(scored: DataFrame, group: Sequence[str] = ("tool",), cut: Cut = uncut) -> DataFrame:
    return curve(cut(score_counts(scored, group)), group)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _both_classes() -> Column:
    return (F.col("p") > 0) & (F.col("n") > 0)


def precision() -> Column:
    return F.try_divide(_d("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return F.try_divide(_d("tp"), F.col("p"))


def prior_precision() -> Column:
    """Precision one point higher on the curve; 1 above the highest score."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(F.try_divide(tp.cast("double"), tp + fp))


def prior_recall() -> Column:
    return F.try_divide((F.col("tp") - F.col("pos")).cast("double"), F.col("p"))


def roc_points(points: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """``<group>, threshold, fpr, tpr`` with the starting point (0, 0), whose threshold is NULL."""
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(_d("fp"), F.col("n")).alias("fpr"),
        recall().alias("tpr"),
    )
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _with_extra_point(points, group, point, start)


def pr_points(points: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """``<group>, threshold, precision, recall`` with the end point (1, 0), whose threshold is NULL."""
    point = F.struct(F.col("score").alias("threshold"), precision().alias("precision"), recall().alias("recall"))
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return _with_extra_point(points, group, point, end)


def _with_extra_point(points: DataFrame, group: Sequence[str], point: Column, extra: Column) -> DataFrame:
    topmost = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    both = F.when(topmost, F.array(extra, point)).otherwise(F.array(point))
    return points.filter(_both_classes()).select(*group, F.inline(both))


# Aggregates over the points of one group. All keep primitive buffers, so one hash aggregate
# computes any selection of them; counts multiply as DECIMAL(38,0), exact up to 10^18 rows.


def auroc() -> Column:
    """Area under the ROC curve; ties count half."""
    term = F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    area = F.try_divide(F.sum(term).cast("double"), 2.0 * F.max(_d("p")) * F.max(_d("n")))
    return F.when((F.max("p") > 0) & (F.max("n") > 0), area)


def auprc() -> Column:
    """Area under the precision-recall curve, trapezoids."""
    area = F.sum(F.try_divide(_d("pos"), F.col("p")) * (precision() + prior_precision()) / 2)
    return F.when((F.max("p") > 0) & (F.max("n") > 0), area)


def average_precision() -> Column:
    """Step-wise average precision; not the trapezoid area."""
    return F.when(
        (F.max("p") > 0) & (F.max("n") > 0), F.sum(F.try_divide(_d("pos"), F.col("p")) * precision())
    )


def best_precision(target: float = RECALL_TARGET) -> Column:
    """Highest precision among points with recall >= target."""
    return F.when((F.max("p") > 0) & (F.max("n") > 0), F.max(F.when(recall() >= target, precision())))


def best_recall(target: float = PRECISION_TARGET) -> Column:
    """Highest recall among points with precision >= target; 0 if no point has it."""
    reached = F.coalesce(F.max(F.when(precision() >= target, recall())), F.lit(0.0))
    return F.when((F.max("p") > 0) & (F.max("n") > 0), reached)


def areas(points: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    return points.groupBy(*group).agg(
        auroc().alias("auroc"), auprc().alias("auprc"), average_precision().alias("average_precision")
    )


def precision_at_recall(
    points: DataFrame, group: Sequence[str] = ("tool",), target: float = RECALL_TARGET, rule: str = "aligned"
) -> DataFrame:
    """``<group>, precision, threshold`` of the best point with recall >= target.

    Equal precision: the lowest threshold. ``rule='reference'`` reports the next lower score
    instead of the score the precision belongs to.
    """
    usable = points.filter(_both_classes())
    here = F.struct(precision().alias("v"), (-F.col("score")).alias("s"))
    prior = F.struct(prior_precision().alias("v"), (-F.col("score")).alias("s"))
    prior_ok = prior_recall() >= target
    best = usable.groupBy(*group).agg(
        F.max(F.when(recall() >= target, here)).alias("_here"),
        F.min("score").alias("_lowest"),
        F.max(F.when(prior_ok, prior)).alias("_prior"),
    )
    threshold = -F.col("_here.s")
    if _reference(rule):
        lower = F.when(threshold == F.col("_lowest"), threshold).otherwise(
            F.when(F.col("_prior.v") == F.col("_here.v"), -F.col("_prior.s"))
        )
        threshold = F.coalesce(lower, threshold)
    return best.select(*group, F.col("_here.v").alias("precision"), threshold.alias("threshold"))


def _reference(rule: str) -> bool:
    if rule not in ("aligned", "reference"):
        raise ValueError("rule must be aligned or reference")
    return rule == "reference"


def recall_at_precision(
    points: DataFrame, group: Sequence[str] = ("tool",), target: float = PRECISION_TARGET, rule: str = "aligned"
) -> DataFrame:
    """``<group>, recall, threshold`` of the best point with precision >= target.

    If no point has the precision, recall is 0.0 and the threshold NULL.
    """
    chosen = _precision_threshold(target, rule)
    return points.filter(_both_classes()).groupBy(*group).agg(
        best_recall(target).alias("recall"), chosen["threshold"].alias("threshold")
    )


def _recall_threshold(target: float, rule: str) -> dict[str, Column]:
    # Recall grows as the score falls, so the highest score that qualifies has the smallest counts.
    ok = recall() >= target
    if _reference(rule):
        above_ok = prior_recall() >= target
        return {
            "threshold": F.coalesce(F.max(F.when(above_ok, F.col("score"))), F.min("score")),
            "tp": F.coalesce(F.min(F.when(above_ok, F.col("tp"))), F.max("tp")),
            "fp": F.coalesce(F.min(F.when(above_ok, F.col("fp"))), F.max("fp")),
        }
    return {
        "threshold": F.max(F.when(ok, F.col("score"))),
        "tp": F.min(F.when(ok, F.col("tp"))),
        "fp": F.min(F.when(ok, F.col("fp"))),
    }


def _precision_threshold(target: float, rule: str) -> dict[str, Column]:
    # The best recall at a precision sits at the lowest score that has it, with the largest counts.
    ok = precision() >= target
    chosen = F.min(F.when(ok, F.col("score")))
    if _reference(rule):
        above_ok = prior_precision() >= target
        lowest = F.min("score")

        def pick(here: Column, lower: Column) -> Column:
            return F.when(chosen == lowest, here).otherwise(lower)

        return {
            "threshold": pick(chosen, F.min(F.when(above_ok, F.col("score")))),
            "tp": pick(F.max(F.when(ok, F.col("tp"))), F.max(F.when(above_ok, F.col("tp")))),
            "fp": pick(F.max(F.when(ok, F.col("fp"))), F.max(F.when(above_ok, F.col("fp")))),
        }
    return {
        "threshold": chosen,
        "tp": F.max(F.when(ok, F.col("tp"))),
        "fp": F.max(F.when(ok, F.col("fp"))),
    }


def operating_points(
    points: DataFrame,
    group: Sequence[str] = ("tool",),
    settings: Sequence[tuple[str, float]] = OPERATING_SETTINGS,
    rule: str = "aligned",
) -> DataFrame:
    """One row per group and setting: threshold, precision, recall and the four counts there.

    A setting nobody reaches gives a row of NULLs. All settings come from one aggregate.
    """
    packed = []
    for kind, target in settings:
        chosen = (_recall_threshold if kind == "Recall" else _precision_threshold)(target, rule)
        packed.append(
            F.struct(
                F.lit(f"{kind}@{target:.2f}").alias("setting"),
                chosen["threshold"].alias("threshold"),
                chosen["tp"].alias("tp"),
                chosen["fp"].alias("fp"),
                F.max("p").alias("p"),
                F.max("n").alias("n"),
            )
        )
    rows = points.groupBy(*group).agg(F.array(*packed).alias("_rows")).select(*group, F.inline("_rows"))
    return rows.select(
        *group,
        "setting",
        "threshold",
        precision().alias("precision"),
        recall().alias("recall"),
        "tp",
        "fp",
        (F.col("n") - F.col("fp")).alias("tn"),
        (F.col("p") - F.col("tp")).alias("fn"),
    )


def threshold_sweep(scored: DataFrame, group: Sequence[str] = ("tool",), cut: Cut = uncut) -> DataFrame:
    """Counts and rates at every distinct score and at the grid 0, 0.005, ..., 1.

    Grid thresholds join the histogram as rows without a class, so one cumulative pass answers
    every threshold; there is no threshold-by-row product.
    """
    grid = F.explode(F.array(*[F.lit(i / SWEEP_STEPS) for i in range(SWEEP_STEPS + 1)]))
    usable = scored.filter(F.col("label").isin(0, 1) & F.col("prob").isNotNull() & ~F.isnan("prob")).select(
        *group, F.col("prob").cast("double").alias("score"), F.col("label").cast("int").alias("label")
    )
    gridded = usable.groupBy(*group).agg(F.lit(None).cast("int").alias("label")).select(
        *group, grid.alias("score"), "label"
    )
    counts = (
        usable.unionByName(gridded)
        .groupBy(*group, "score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    points = curve(cut(counts), group)
    return sweep_rates(points.withColumnRenamed("score", "threshold"), [*group, "threshold"])


def sweep_rates(points: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The rates of a sweep row from ``tp, fp, p, n``; empty denominators give 0."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    tpr, fpr = ratio_or_zero(tp, p), ratio_or_zero(fp, n)
    return points.select(
        *keep,
        "tp",
        "fp",
        (n - fp).alias("tn"),
        (p - tp).alias("fn"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        tpr.alias("recall"),
        ratio_or_zero(2 * tp, tp + fp + p).alias("f1"),
        ratio_or_zero(tp + n - fp, p + n).alias("accuracy"),
        tpr.alias("tpr"),
        fpr.alias("fpr"),
        (tpr - fpr).alias("youden"),
    )


def best_thresholds(sweep: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Best row by F1 and by Youden's J; the lowest threshold wins a tie."""

    def best(by: str) -> Column:
        row = F.struct(F.lit(by).alias("criterion"), "threshold", "precision", "recall", "f1", "accuracy", "tpr",
                       "fpr", "youden")
        return F.max_by(row, F.struct(F.col(by), -F.col("threshold")))

    both = sweep.groupBy(*group).agg(F.array(best("f1"), best("youden")).alias("_rows"))
    return both.select(*group, F.inline("_rows"))


def best_f1_on_grid(scored: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Best F1 over the thresholds 0.05, 0.10, ..., 0.95; the first one wins a tie, 0.5 if all are 0.

    Each row is reduced to the number of grid thresholds it reaches, so at most twenty rows per
    group and task are shuffled.
    """
    grid = [percent / 100 for percent in F1_GRID_PERCENT]
    reached = sum((F.col("prob") >= t).cast("int") for t in grid)
    cells = (
        scored.filter(F.col("label").isin(0, 1) & F.col("prob").isNotNull())
        .groupBy(*group, reached.alias("k"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    # A row that reaches k thresholds counts at each of the first k; step 0 counts every row.
    steps = (
        cells.select(*group, "pos", "neg", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        .groupBy(*group, "i")
        .agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
        .withColumn("p", F.max("tp").over(Window.partitionBy(*group)))
    )
    table = steps.withColumn("threshold", F.get(F.array(*[F.lit(t) for t in grid]), F.col("i") - 1))
    at = ratio_or_zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    f1 = F.when(F.col("i") > 0, at).otherwise(0.0)
    best = table.withColumn("f1", f1).groupBy(*group).agg(
        F.max("f1").alias("f1"),
        F.max_by("threshold", F.when(F.col("i") > 0, F.struct("f1", -F.col("threshold")))).alias("_t"),
    )
    return best.select(
        *group, F.when(F.col("f1") > 0, F.col("_t")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"), "f1"
    )

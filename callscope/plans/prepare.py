"""From labelled variants, reads and signals to feature rows, a model and positional predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.keys import variant_key
from callscope.operators import curves, features, learn, metrics, regions, resample
from callscope.operators.align import merge_labelled
from callscope.sources import sinks


def labelled_variants(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Both sources stacked, with their key."""
    return merge_labelled(negatives, positives).withColumn("key", variant_key(normalise=False))


def evidence_table(
    variants: DataFrame, reads: DataFrame, mappability: DataFrame, timing: DataFrame, radius: int = 100
) -> DataFrame:
    """Read evidence, mean mappability and mean replication timing per distinct site."""
    unique = variants.select("key", "chrom", "pos", "ref", "alt").distinct()
    windows = unique.select(
        "key",
        "chrom",
        F.greatest(F.col("pos") - 1 - radius, F.lit(0)).cast("bigint").alias("start"),
        (F.col("pos") + radius).cast("bigint").alias("end"),
    )
    return features.merge_evidence(
        regions.window_signal(windows, mappability),
        regions.window_signal(windows, timing),
        regions.pileup(unique, reads),
    )


def train(features_table: DataFrame, kind: str = "logistic", pos_weight: float | None = None) -> PipelineModel:
    """Fit on the hashed 80 % of ``key, seq, qc, y``."""
    rows = learn.vectorise(features_table.withColumnRenamed("y", "label"), ["qc", "seq"])
    split = resample.hash_split(rows).filter(F.col("split") == "train")
    return learn.classifier(kind).fit(learn.with_class_weight(split, pos_weight))


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AUROC, average precision, accuracy and counts of one set of predictions, as one row."""
    points = curves.scored_curve(scored, [])
    areas = points.agg(curves.auroc().alias("auroc"), curves.average_precision().alias("ap"))
    counts = metrics.threshold_metrics(scored, threshold, [])
    one = F.struct(*counts.columns)
    at = counts.select(one.alias("c")).scalar()
    return areas.select("auroc", "ap", *[at[c].alias(c) for c in ("accuracy", "tp", "tn", "fp", "fn")])


def write_evaluation(scored: DataFrame, path: str, threshold: float = 0.5) -> None:
    names = {
        "auroc": "AUROC",
        "ap": "AP",
        "accuracy": f"ACC@{threshold}",
        "tp": "TP",
        "tn": "TN",
        "fp": "FP",
        "fn": "FN",
    }
    sinks.write_lines(sinks.metric_lines(evaluate(scored, threshold), names).coalesce(1), path)

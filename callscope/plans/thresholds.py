"""The balanced-sample threshold and its confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import curves, metrics, resample


def best_on_balanced(scored: DataFrame, key: str = "key", seed: int = resample.SAMPLE_SEED) -> DataFrame:
    """Best F1 threshold of the 19-point grid on a balanced sample."""
    return curves.best_f1_on_grid(resample.balanced_sample(scored, key, seed), [])


def confusion_at_best(scored: DataFrame, criterion: str = "f1") -> DataFrame:
    """Row-normalised confusion matrix at the best threshold of the full sweep."""
    best = curves.best_thresholds(curves.threshold_sweep(scored, []), [])
    threshold = best.filter(F.col("criterion") == criterion).select("threshold").scalar()
    return metrics.confusion_normalised(scored, threshold, [])

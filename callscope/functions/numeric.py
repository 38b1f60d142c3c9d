"""Numeric expressions: coercion, clipping, ratios, logistic scores, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality scale of the logistic score and the allele-fraction bins (left-closed).
QUALITY_SCALE = 10.0
VAF_EDGES = (0.0, 0.05, 0.10, 0.20, 1.01)
VAF_LABELS = ("<5%", "5-10%", "10-20%", ">=20%")
DEPTH_LABELS = ("low", "med", "high")
COUNT_SEPARATORS = "[,:;]"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value) -> Column:
    """Number or NULL: bad text, NaN and both infinities all count as missing."""
    number = _col(value).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number)


def clip(value, low: float | None = None, high: float | None = None) -> Column:
    """Clip, leaving NULL alone (``least``/``greatest`` on their own would turn it into a bound)."""
    column = _col(value)
    clipped = column
    if low is not None:
        clipped = F.greatest(clipped, F.lit(low))
    if high is not None:
        clipped = F.least(clipped, F.lit(high))
    return F.when(column.isNotNull(), clipped)


def ratio_or_zero(numerator, denominator) -> Column:
    """Quotient, 0.0 on an empty denominator."""
    return F.coalesce(F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double")), F.lit(0.0))


def allele_fraction(ref_count, alt_count) -> Column:
    """alt / (ref + alt) from two counts; NULL at depth 0."""
    ref = clip(to_number(ref_count), 0.0)
    alt = clip(to_number(alt_count), 0.0)
    return F.try_divide(alt, ref + alt)


def allele_depth(ref_count, alt_count) -> Column:
    return clip(to_number(ref_count), 0.0) + clip(to_number(alt_count), 0.0)


def count_pair(pair) -> tuple[Column, Column]:
    """Reference and alternative count inside one text such as ``31,4``."""
    parts = F.split(_col(pair).cast("string"), COUNT_SEPARATORS)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def logistic_quality(quality) -> Column:
    """1 / (1 + e^(-q/10))."""
    return 1.0 / (1.0 + F.exp(-to_number(quality) / QUALITY_SCALE))


def sigmoid(logit) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(logit).cast("double")))


def hard_call(prob, threshold: float | Column = 0.5) -> Column:
    return (_col(prob) >= threshold).cast("int")


def fixed_bin(value, edges: Sequence[float] = VAF_EDGES, labels: Sequence[str] = VAF_LABELS) -> Column:
    """Label of the left-closed bin holding ``value``; NULL outside all bins."""
    column = _col(value)
    result = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        result = F.when((column >= low) & (column < high), F.lit(label)).otherwise(result)
    return result


def right_closed_bin(value, edges: Sequence[Column], labels: Sequence[str] = DEPTH_LABELS) -> Column:
    """Label of the right-closed bin, the first edge included; edges may be columns."""
    column = _col(value)
    result = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        inside = (column <= edges[i + 1]) & ((column >= edges[i]) if i == 0 else (column > edges[i]))
        result = F.when(inside, F.lit(labels[i])).otherwise(result)
    return result

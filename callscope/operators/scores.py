"""Turn the raw columns of a caller into one score in [0, 1]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.numeric import (
    allele_depth,
    allele_fraction,
    clip,
    count_pair,
    logistic_quality,
    to_number,
)

# Column names searched (case-insensitive, in this order) and the preference chains.
FRACTION_COLUMNS = ("af", "tumoraf", "tumor_af", "fa")
REF_COUNT_COLUMNS = ("t_ref_count", "tumor_ref_count", "tref", "ref_count")
ALT_COUNT_COLUMNS = ("t_alt_count", "tumor_alt_count", "talt", "alt_count")
PAIR_COLUMNS = ("ad", "tumor_ad")
CHAINS = {
    "tlod": ("tlod", "af", "qual"),
    "somaticevs": ("somaticevs", "af", "qual"),
    "generic": ("prob", "score", "af", "qual"),
    "simple": ("prob", "score", "qual", "half"),
    "default": ("tlod", "somaticevs", "prob", "score", "af", "qual"),
}
SCALED = ("tlod", "somaticevs")
PASS_SCORE, FILTERED_SCORE, DEFAULT_SCORE = 1.0, 0.5, 0.5


def _find(frame: DataFrame, names: Sequence[str]) -> str | None:
    have = {c.lower(): c for c in frame.columns}
    return next((have[n] for n in names if n in have), None)


def _bounds(rows: DataFrame, number: Column) -> Column:
    """Lowest and highest value of a table as a scalar subquery; attach it to a frame once."""
    return rows.agg(F.struct(F.min(number).alias("low"), F.max(number).alias("high"))).scalar()


def minmax_scale(rows: DataFrame, value: str, output: str | None = None) -> DataFrame:
    """Scale a column to [0, 1] over the whole table.

    A constant column stays unscaled with missing values as 0; otherwise missing stays missing.
    """
    number = to_number(value)
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    constant = low.isNull() | (low == high)
    scaled = F.when(constant, F.coalesce("_number", F.lit(0.0))).otherwise((F.col("_number") - low) / (high - low))
    measured = rows.withColumns({"_number": number, "_bounds": _bounds(rows, number)})
    return measured.withColumn(output or value, scaled).drop("_number", "_bounds")


def fraction_and_depth(frame: DataFrame) -> tuple[Column | None, Column]:
    """Allele fraction and depth from whichever columns the table has; depth only from counts."""
    no_depth = F.lit(None).cast("double")
    given = _find(frame, FRACTION_COLUMNS)
    if given:
        return to_number(given), no_depth
    ref, alt = _find(frame, REF_COUNT_COLUMNS), _find(frame, ALT_COUNT_COLUMNS)
    if ref and alt:
        return allele_fraction(ref, alt), allele_depth(ref, alt)
    pair = _find(frame, PAIR_COLUMNS)
    if pair:
        ref_count, alt_count = count_pair(pair)
        return allele_fraction(ref_count, alt_count), allele_depth(ref_count, alt_count)
    return None, no_depth


def annotation(frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame | None:
    """``key, vaf_est, depth_est`` of one source, or None if it has no such columns."""
    fraction, depth = fraction_and_depth(frame)
    if fraction is None:
        return None
    return frame.select("key", clip(fraction, 0.0, 1.0).alias("vaf_est"), depth.alias("depth_est"), *keep)


def _link(frame: DataFrame, name: str) -> Column | None:
    if name == "half":
        return F.lit(DEFAULT_SCORE)
    if name == "af":
        fraction, depth = fraction_and_depth(frame)
        if fraction is None:
            return None
        counted = _find(frame, FRACTION_COLUMNS) is None
        return clip(F.coalesce(fraction, F.lit(0.0)) if counted else fraction, 0.0, 1.0)
    column = _find(frame, (name,))
    if column is None:
        return None
    if name == "qual":
        return logistic_quality(column)
    return to_number(column)


def score_chain(frame: DataFrame, chain: str | Sequence[str] = "default", output: str = "prob") -> DataFrame:
    """Add the score from the first link of the chain whose columns exist; rows without a value get 0.

    The choice is made once from the schema, not per row.
    """
    links = CHAINS[chain] if isinstance(chain, str) else chain
    name, chosen = next(
        ((n, c) for n, c in ((n, _link(frame, n)) for n in links) if c is not None), ("", F.lit(0.0))
    )
    scored = frame.withColumn(output, chosen.cast("double"))
    if name in SCALED:
        scored = minmax_scale(scored, output)
    return scored.withColumn(output, F.coalesce(output, F.lit(0.0)))


def constant_fallback(rows: DataFrame, value: str = "prob") -> DataFrame:
    """If the score is the same everywhere, score presence instead.

    PASS rows get 1.0 and others 0.5; without a filter column every row gets 1.0.
    """
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    constant = low.isNull() | (low == high)
    column = _find(rows, ("filter",))
    if column is None:
        presence = F.lit(PASS_SCORE)
    else:
        passed = F.coalesce(F.upper(F.col(column).cast("string")) == "PASS", F.lit(False))
        presence = F.when(passed, PASS_SCORE).otherwise(FILTERED_SCORE)
    bounded = rows.withColumn("_bounds", _bounds(rows, F.col(value)))
    return bounded.withColumn(value, F.when(constant, presence).otherwise(F.col(value))).drop("_bounds")


def caller_score(frame: DataFrame, chain: str | Sequence[str] = "default") -> DataFrame:
    """The whole preference chain: choose, fill, fall back on presence, clip to [0, 1]."""
    scored = constant_fallback(score_chain(frame, chain))
    return scored.withColumn("prob", clip("prob", 0.0, 1.0))

"""Variant keys: normalise the parts, build the key, take it apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and separators of the key format.
CHROM_PREFIX = "chr"
ALLELE_SEPARATORS = ",;"
WHOLE_NUMBER = r"^\d+(\.\d+)?$"
KEY_SEPARATOR = ":"


def _text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def norm_chrom(chrom) -> Column:
    """Drop a leading ``chr``; nothing else of the name changes."""
    text = _text(chrom)
    rest = F.substring(text, len(CHROM_PREFIX) + 1, 1 << 30)
    return F.when(F.startswith(text, F.lit(CHROM_PREFIX)), rest).otherwise(text)


def norm_allele(allele) -> Column:
    """First of several alleles, upper-cased."""
    first, other = ALLELE_SEPARATORS
    return F.upper(F.substring_index(F.translate(_text(allele), other, first), first, 1))


def norm_pos(pos) -> Column:
    """``"123.0"`` becomes ``"123"``; text that is not a plain number stays as it is.

    The pattern is only tried where it can change something: at a dot or a leading zero.
    """
    text = _text(pos)
    whole = F.floor(text.try_cast("double")).cast("bigint").cast("string")
    odd = F.contains(text, F.lit(".")) | F.startswith(text, F.lit("0"))
    return F.when(odd & text.rlike(WHOLE_NUMBER), whole).otherwise(text)


def variant_key(chrom="chrom", pos="pos", ref="ref", alt="alt", normalise: bool = True) -> Column:
    """``chrom:pos:ref:alt``; NULL if any part is NULL (``concat`` keeps NULL, ``concat_ws`` hides it)."""
    if normalise:
        parts = [norm_chrom(chrom), norm_pos(pos), norm_allele(ref), norm_allele(alt)]
    else:
        parts = [_text(part) for part in (chrom, pos, ref, alt)]
    return F.concat(
        parts[0], F.lit(KEY_SEPARATOR), parts[1], F.lit(KEY_SEPARATOR), parts[2], F.lit(KEY_SEPARATOR), parts[3]
    )


def split_key(key="key") -> list[Column]:
    """The four columns behind a key; ``pos`` is NULL where it is not a number."""
    parts = F.split(_text(key), KEY_SEPARATOR)
    return [
        F.get(parts, F.lit(0)).alias("chrom"),
        F.floor(F.get(parts, F.lit(1)).try_cast("double")).cast("bigint").alias("pos"),
        F.get(parts, F.lit(2)).alias("ref"),
        F.get(parts, F.lit(3)).alias("alt"),
    ]


def split_alts(alt="alt") -> Column:
    """One row per alternative allele; use inside a select."""
    return F.explode(F.split(_text(alt), ","))

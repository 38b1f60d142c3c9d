"""Find columns under their many names; check that required ones exist."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted names, best first.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "chrom": ("chrom", "chromosome", "chr", "#chrom", "contig", "seqnames"),
    "pos": ("pos", "position", "start", "start_position", "bp", "start_bp"),
    "ref": ("ref", "reference", "ref_allele", "reference_allele"),
    "alt": ("alt", "alt_allele", "alternate", "alt1", "tumor_seq_allele2"),
}
LABEL_SYNONYMS = ("label", "seqc2_positive", "y")


class ColumnError(ValueError):
    """A required column is missing or a name fits several columns."""


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First name that fits a column exactly (letters and digits only), else the one containing it.

    Two columns containing a name are an error: guessing would silently read the wrong one.
    """
    plain: dict[str, str] = {}
    for column in columns:
        plain.setdefault(_plain(column), column)
    for name in names:
        if _plain(name) in plain:
            return plain[_plain(name)]
    for name in names:
        near = [c for c in columns if _plain(name) and _plain(name) in _plain(c)]
        if len(near) > 1:
            raise ColumnError(f"{name!r} fits several columns: {near}")
        if near:
            return near[0]
    return None


def resolve_columns(
    frame: DataFrame, wanted: Mapping[str, Sequence[str]] = SYNONYMS, keep_rest: bool = False
) -> DataFrame:
    """Select the wanted columns under their canonical names. Works on the schema only."""
    found = {canon: find_column(frame.columns, names) for canon, names in wanted.items()}
    missing = [canon for canon, column in found.items() if column is None]
    if missing:
        raise ColumnError(f"missing columns {missing}; the table has {frame.columns}")
    picked = [F.col(f"`{column}`").alias(canon) for canon, column in found.items()]
    rest = [F.col(f"`{c}`") for c in frame.columns if c not in set(found.values()) and c not in found]
    return frame.select(*picked, *(rest if keep_rest else []))


def require_columns(frame: DataFrame, names: Sequence[str], exact_order: bool = False) -> DataFrame:
    """Raise before any job runs if columns are missing (or do not lead the table in this order)."""
    if exact_order:
        if list(frame.columns[: len(names)]) != list(names):
            raise ColumnError(f"expected the first columns {list(names)}, got {frame.columns}")
    else:
        missing = [n for n in names if n not in frame.columns]
        if missing:
            raise ColumnError(f"missing columns {missing}; the table has {frame.columns}")
    return frame

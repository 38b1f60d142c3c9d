"""Sequence and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel order of the encoding, filler outside a contig, order of the evidence vector.
BASES = ("A", "C", "G", "T")
PAD = "N"
QC_FIELDS = ("DP", "AD", "VAF", "MQ", "SB", "MAP", "RTIM")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def one_hot(seq) -> Column:
    """Four 0/1 rows (A, C, G, T) over the sequence; any other letter is a zero column."""
    letters = F.split(F.translate(_col(seq), "acgt", "ACGT"), "")
    return F.transform(
        F.array(*[F.lit(base) for base in BASES]),
        lambda base: F.transform(letters, lambda letter: (letter == base).cast("tinyint")),
    )


def transpose(matrix, width: Column | int | None = None) -> Column:
    """Swap the two axes of an array of equally long arrays."""
    rows = _col(matrix)
    size = F.size(rows[0]) if width is None else (F.lit(width) if isinstance(width, int) else width)
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.transform(rows, lambda row: F.get(row, i))
    )


def channels_first(matrix, channels: int = 4) -> Column:
    """(L, 4) becomes (4, L); what is already (4, L) stays."""
    rows = _col(matrix)
    flip = (F.size(rows) != channels) & (F.size(F.get(rows, F.lit(0))) == channels)
    return F.when(flip, transpose(rows, channels)).otherwise(rows)


def qc_vector(fields=QC_FIELDS) -> Column:
    """Evidence values in their fixed order, missing ones as 0."""
    return F.array(*[F.coalesce(F.col(name).cast("float"), F.lit(0.0).cast("float")) for name in fields])


def cut_window(text, text_start, start, length) -> Column:
    """``length`` letters from absolute offset ``start`` out of ``text``, which begins at ``text_start``.

    Letters before offset 0 or behind the end of ``text`` are filled with N.
    """
    start, length, text_start = _col(start), _col(length), _col(text_start)
    left = F.greatest(-start, F.lit(0))
    first = F.greatest(start, F.lit(0)) - text_start
    body = F.concat(
        F.repeat(F.lit(PAD), left.cast("int")), F.substr(_col(text), (first + 1).cast("int"), (length - left).cast("int"))
    )
    return F.rpad(body, length.cast("int"), PAD)

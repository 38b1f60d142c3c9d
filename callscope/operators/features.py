"""Evidence tables and feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.numeric import to_number
from callscope.functions.sequence import QC_FIELDS, cut_window, one_hot, qc_vector
from callscope.operators import skew

# Letters per reference chunk, fields of the read evidence and of the signals.
CHUNK = 4096
EVIDENCE_FIELDS = QC_FIELDS[:5]
SIGNAL_FIELDS = QC_FIELDS[5:]


def merge_evidence(
    mappability: DataFrame, timing: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """Full outer merge of two signal tables and the read evidence on the key; missing values are 0.

    ``mappability`` and ``timing`` carry ``key, mean``; keys are unique in each table. A full
    outer join loses its partitioning on the coalesced key, so chaining two of them shuffles
    the first result again; stacking the three tables and grouping by key shuffles once.
    """
    parts = [
        mappability.select("key", to_number("mean").alias("MAP")),
        timing.select("key", to_number("mean").alias("RTIM")),
    ]
    if evidence is not None:
        parts.append(evidence.select("key", *[to_number(c).alias(c) for c in EVIDENCE_FIELDS]))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    have = set(stacked.columns)
    merged = stacked.groupBy("key").agg(*[F.max(c).alias(c) for c in QC_FIELDS if c in have])
    zero = F.lit(0.0)
    return merged.select(
        "key", *[(F.coalesce(c, zero) if c in have else zero).alias(c) for c in QC_FIELDS]
    )


def feature_join(variants: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence beside every variant row; variants without evidence get 0. Hot keys are split."""
    joined = skew.left_join(variants, evidence.select("key", *QC_FIELDS), ["key"])
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in QC_FIELDS})


def with_qc_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("qc", qc_vector())


def sequence_windows(sites: DataFrame, chunks: DataFrame, radius: int = 100, stride: int = CHUNK) -> DataFrame:
    """The ``2*radius+1`` letters around every site as ``seq``, filled with N outside the contig.

    ``sites``: contig, pos (1-based) and anything else; ``chunks``: see ``sources.fasta``, cut with
    the same ``stride`` and a halo of at least twice the radius, so that a window lies inside
    exactly one chunk: one equi-join, and no regrouping of pieces; a shorter halo is an error. A window that does not touch
    its contig, or whose contig is unknown, gives NULL.
    """
    start = F.col("pos").cast("bigint") - 1 - radius
    first = F.greatest(start, F.lit(0).cast("bigint"))
    placed = sites.withColumns({"_start": start, "chunk_id": F.floor(first / F.lit(stride)).cast("bigint")})
    pieces = chunks.select("contig", "chunk_id", "offset", "text", "halo")
    joined = skew.left_join(placed, pieces, ["contig", "chunk_id"])
    length = 2 * radius + 1
    touches = (F.col("_start") + length > 0) & (F.col("_start") < F.col("offset") + F.length("text"))
    short = F.raise_error(F.lit(f"chunks need a halo of at least {2 * radius} letters for this radius")).cast("string")
    cut = cut_window("text", "offset", "_start", F.lit(length))
    window = F.when(F.col("halo") < 2 * radius, short).when(touches, cut)
    return joined.withColumn("seq", window).drop("chunk_id", "offset", "text", "halo", "_start")


def feature_rows(
    variants: DataFrame, evidence: DataFrame, chunks: DataFrame, radius: int = 100, stride: int = CHUNK
) -> DataFrame:
    """``key, seq, qc, y``: one-hot sequence, evidence vector and label per variant."""
    placed = variants
    if "contig" not in variants.columns:
        placed = variants.withColumn("contig", F.concat(F.lit("chr"), "chrom"))
    windows = sequence_windows(placed, chunks, radius, stride)
    return with_qc_vector(feature_join(windows, evidence)).select(
        "key", one_hot("seq").alias("seq"), "qc", F.col("label").cast("int").alias("y")
    )

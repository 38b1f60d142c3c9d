"""Reference sequences as a table of overlapping chunks.

``contig, chunk_id, offset, text, halo``: chunk k covers letters ``[k*stride, (k+1)*stride + halo)``, so
any window up to the halo in length lies inside the chunk its first letter belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.operators.features import CHUNK

HALO = 512


def chunk_text(contigs: DataFrame, stride: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Cut contigs that are rows ``contig, text`` into chunks; no shuffle, one pass over each text."""
    pieces = contigs.select("contig", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("_pieces"))
    behind = -(-halo // stride)

    def chunk(piece, k):
        following = F.array_join(F.slice("_pieces", k + 2, F.lit(behind)), "")
        return F.struct(
            k.cast("bigint").alias("chunk_id"),
            (k.cast("bigint") * stride).alias("offset"),
            F.concat(piece, F.substr(following, F.lit(1), F.lit(halo))).alias("text"),
            F.lit(halo).alias("halo"),
        )

    return pieces.select("contig", F.inline(F.transform("_pieces", chunk)))


def read_fasta(
    spark: SparkSession, path: str | Sequence[str], stride: int = CHUNK, halo: int = HALO
) -> DataFrame:
    """Chunks straight from the lines of FASTA files."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return assemble_chunks(place_lines(lines), stride, halo)


def place_lines(lines: DataFrame) -> DataFrame:
    """``contig, offset, text`` of every sequence line.

    ``lines``: line, file, block (order of the split inside its file) and at (order inside the
    split). A whole chromosome never becomes one row. Lines are placed in two steps: inside the file
    split they come from, and then across splits by adding up what each split contributes - its
    last contig name and the letters behind it.
    """
    lines = lines.withColumn("line", F.trim("line"))
    is_header = F.startswith("line", F.lit(">"))
    named = lines.withColumns(
        {
            "name": F.when(is_header, F.regexp_extract("line", r"^>(\S*)", 1)),
            "letters": F.when(is_header, F.lit(0)).otherwise(F.length("line")).cast("bigint"),
        }
    )
    in_split = Window.partitionBy("file", "block").orderBy("at")
    upto = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = named.withColumns(
        {
            "contig_here": F.last("name", ignorenulls=True).over(upto),
            "end_here": F.sum("letters").over(upto),
        }
    ).withColumn("since", F.max(F.when(F.col("name").isNotNull(), F.col("end_here"))).over(upto))

    splits = placed.groupBy("file", "block").agg(
        F.max_by("contig_here", "at").alias("last_contig"),
        F.sum("letters").alias("total"),
        F.max("since").alias("before_last"),
    )
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    tail = F.col("total") - F.coalesce("before_last", F.lit(0).cast("bigint"))
    # Letters seen in the file up to the split, less those before its last header so far.
    carried = splits.withColumns(
        {
            "contig_in": F.last("last_contig", ignorenulls=True).over(before),
            "seen": F.coalesce(F.sum("total").over(before), F.lit(0).cast("bigint")),
        }
    ).withColumn("header_at", F.when(F.col("last_contig").isNotNull(), F.col("seen") + F.col("total") - tail))
    carried = carried.withColumn(
        "offset_in", F.col("seen") - F.coalesce(F.max("header_at").over(before), F.lit(0).cast("bigint"))
    ).select("file", "block", "contig_in", "offset_in")

    return (
        placed.filter(F.col("name").isNull() & (F.col("letters") > 0))
        .join(carried, ["file", "block"])
        .select(
            F.coalesce("contig_here", "contig_in").alias("contig"),
            F.when(F.col("contig_here").isNotNull(), F.col("end_here") - F.col("since") - F.col("letters"))
            .otherwise(F.col("offset_in") + F.col("end_here") - F.col("letters"))
            .alias("offset"),
            F.col("line").alias("text"),
        )
        .filter(F.col("contig").isNotNull())
    )


def assemble_chunks(pieces: DataFrame, stride: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Chunks from consecutive pieces ``contig, offset, text``; each group is one chunk's letters."""
    end = F.col("offset") + F.length("text")
    first = F.greatest(F.floor((F.col("offset") - halo) / F.lit(stride)), F.lit(0)).cast("bigint")
    last = F.floor((end - 1) / F.lit(stride)).cast("bigint")
    spread = pieces.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("offset"), F.col("chunk_id") * stride)
    high = F.least(end, (F.col("chunk_id") + 1) * stride + halo)
    part = F.substr("text", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    parts = spread.select("contig", "chunk_id", low.alias("at"), part.alias("part")).filter(F.length("part") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    text = F.array_join(F.transform(ordered, lambda x: x["part"]), "")
    chunks = parts.groupBy("contig", "chunk_id").agg(text.alias("text"))
    covered = F.length("text") > 0
    return chunks.filter(covered).select(
        "contig", "chunk_id", (F.col("chunk_id") * stride).alias("offset"), "text", F.lit(halo).alias("halo")
    )

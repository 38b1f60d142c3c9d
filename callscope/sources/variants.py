"""Variant files: mutation annotation tables and variant call files (plain or gzipped)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.keys import norm_chrom
from callscope.operators import skew
from callscope.sources import blocked as blocked_gzip

# Required columns and build, patterns of the allele fraction inside INFO.
MAF_COLUMNS = ("chromosome", "start_position", "reference_allele", "tumor_seq_allele2", "ncbi_build")
GENOME_BUILD = "GRCh38"
INFO_FRACTION = r"(?:^|;)AF=([^;]*)"
INFO_FRACTION_LOOSE = r"AF=([0-9\.eE+-]+)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def data_lines(spark: SparkSession, path: str | Sequence[str], blocked: bool = False) -> DataFrame:
    """Lines that are not comments, with the file they come from.

    A gzipped file is read by one task; ``blocked`` reads block-compressed ones by many, see ``sources.blocked``.
    """
    if blocked:
        return without_comments(blocked_gzip.read_lines(spark, path))
    return without_comments(
        spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    )


def without_comments(lines: DataFrame) -> DataFrame:
    """Lines ``line, file`` that are neither empty nor comments, without carriage returns."""
    return lines.select(F.rtrim(F.col("line"), F.lit("\r")).alias("line"), "file").filter(
        ~F.startswith("line", F.lit("#")) & (F.length("line") > 0)
    )


def read_maf(
    spark: SparkSession, path: str | Sequence[str], build: str = GENOME_BUILD, blocked: bool = False
) -> DataFrame:
    """Variants of one genome build from mutation tables, labelled 0; see ``parse_maf``."""
    return parse_maf(data_lines(spark, path, blocked), build)


def parse_maf(lines: DataFrame, build: str = GENOME_BUILD) -> DataFrame:
    """Variants from the lines ``line, file`` of mutation tables.

    The header is the line that names all required columns. Every file brings its own, in its
    own column order. One row per file, with the places of the required columns, is joined to the
    lines; a file of very many lines is split. A file without such a header is an error.
    """
    rows = lines.withColumn("fields", F.split("line", "\t"))
    names = F.transform("fields", lambda field: F.lower(F.trim(field)))
    is_header = F.forall(F.array(*[F.lit(c) for c in MAF_COLUMNS]), lambda c: F.array_contains(names, c))
    marked = rows.select("file", "fields", is_header.alias("is_header"), F.when(is_header, names).alias("names"))
    headers = marked.filter("is_header").groupBy("file").agg(F.min("names").alias("names"))
    places = headers.select("file", *[(F.array_position("names", c) - 1).cast("int").alias(f"at_{c}") for c in MAF_COLUMNS])
    body = skew.left_join(marked.filter(~F.col("is_header")).select("file", "fields"), places, ["file"])
    missing = F.raise_error(F.concat(F.lit("required columns missing in "), F.col("file")))

    def field(name: str) -> Column:
        return F.get("fields", F.when(F.col(f"at_{name}").isNull(), missing.cast("int")).otherwise(F.col(f"at_{name}")))

    return (
        body
        .filter(field("ncbi_build") == build)
        .select(
            norm_chrom(field("chromosome")).alias("chrom"),
            field("start_position").cast("bigint").alias("pos"),
            field("reference_allele").alias("ref"),
            field("tumor_seq_allele2").alias("alt"),
            F.lit(0).alias("label"),
            F.lit("negative").alias("source"),
            F.lit(0).alias("src_rank"),
        )
    )


def read_truth_vcf(spark: SparkSession, path: str | Sequence[str], blocked: bool = False) -> DataFrame:
    """One row per alternative allele, labelled 1."""
    return parse_truth_vcf(data_lines(spark, path, blocked))


def parse_truth_vcf(lines: DataFrame) -> DataFrame:
    fields = F.split("line", "\t")
    return (
        lines.select(fields.alias("f"))
        .select(
            norm_chrom(F.get("f", F.lit(0))).alias("chrom"),
            F.get("f", F.lit(1)).cast("bigint").alias("pos"),
            F.get("f", F.lit(3)).alias("ref"),
            F.explode(F.split(F.get("f", F.lit(4)), ",")).alias("alt"),
            F.lit(1).alias("label"),
            F.lit("positive").alias("source"),
            F.lit(1).alias("src_rank"),
        )
    )


def info_fraction(info, allele=None, strict: bool = True) -> Column:
    """Text of the allele fraction in an INFO field.

    Strict: the field must be called AF, and allele ``allele`` (0, 1, ...) gets its own value if
    there are several. Otherwise the first ``AF=`` anywhere counts for all, also inside ``MAF=``.
    """
    column = F.col(info) if isinstance(info, str) else info
    if not strict:
        return F.nullif(F.regexp_extract(column, INFO_FRACTION_LOOSE, 1), F.lit(""))
    values = F.split(F.nullif(F.regexp_extract(column, INFO_FRACTION, 1), F.lit("")), ",")
    own = F.lit(0) if allele is None else allele
    return F.coalesce(F.get(values, own), F.get(values, F.lit(0)))


def info_score(info, qual, allele=None, strict: bool = True) -> Column:
    """Allele fraction of INFO, else QUAL unless it is ``.``, else 0; NULL where the text is no number."""
    fraction = info_fraction(info, allele, strict)
    quality = F.col(qual) if isinstance(qual, str) else qual
    # Python's float and Spark's cast differ on oddities such as "1d"; the pattern keeps both out.
    text = F.coalesce(fraction, F.when(quality != ".", quality), F.lit("0"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def read_vcf(
    spark: SparkSession, path: str | Sequence[str], strict: bool = True, blocked: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Calls ``chrom, pos, ref, alt, score`` and the lines set aside ``file, line, reason``.

    A short line, a position that is no integer or a score that is no number goes to the second
    frame instead of a log; no line is in both or in neither.
    """
    parsed = parse_calls(data_lines(spark, path, blocked), strict)
    return good_calls(parsed), bad_lines(parsed)


def parse_calls(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines with their fields and, where something is wrong, the ``reason``."""
    fields = F.split("line", "\t")
    parsed = lines.withColumn("f", fields).withColumns(
        {
            "pos": F.get("f", F.lit(1)).try_cast("bigint"),
            "alts": F.split(F.get("f", F.lit(4)), ","),
        }
    )
    one = info_score(F.get("f", F.lit(7)), F.get("f", F.lit(5)), None, strict)
    scores = F.transform(
        "alts",
        lambda alt, i: info_score(F.get("f", F.lit(7)), F.get("f", F.lit(5)), i, strict) if strict else one,
    )
    reason = (
        F.when(F.size("f") < 8, "short line")
        .when(F.col("pos").isNull(), "position is not a number")
        .when(F.exists("scores", lambda s: s.isNull()), "score is not a number")
    )
    return parsed.withColumn("scores", scores).withColumn("reason", reason)


def good_calls(parsed: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("alts").alias("alt"), F.col("scores").alias("score"))
    return parsed.filter(F.col("reason").isNull()).select(
        norm_chrom(F.get("f", F.lit(0))).alias("chrom"),
        "pos",
        F.get("f", F.lit(3)).alias("ref"),
        F.inline(pairs),
    ).toDF("chrom", "pos", "ref", "alt", "score")


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("file", "line", "reason")

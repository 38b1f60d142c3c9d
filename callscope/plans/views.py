"""Views of the benchmark tables that look like the inputs of a comparison.

The same definitions stand, as SQL, in ``oracle.py``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.align import align_universe

TOOLS = ("model", "caller_1", "caller_2")


@lru_cache(maxsize=64)
def _opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table; its footer is read once per session."""
    return _opened(spark, f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS key", "CAST(o_orderstatus = 'F' AS INT) AS label"
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calls of three tools: duplicates, and keys without a call."""
    lineitem = table(spark, sf_dir, "lineitem")
    model = table(spark, sf_dir, "orders").selectExpr(
        "'model' AS tool",
        "CAST(o_orderkey AS STRING) AS key",
        "(7 * CAST(FLOOR(o_totalprice / 5) AS BIGINT) + 300000 * CAST(o_orderstatus = 'F' AS INT)) / 1e6D AS prob",
    )
    first = lineitem.filter("l_linestatus = 'F'").selectExpr(
        "'caller_1' AS tool", "CAST(l_orderkey AS STRING) AS key", "CAST(l_quantity AS BIGINT) / 5e1D AS prob"
    )
    second = lineitem.filter("l_returnflag = 'A' AND l_discount >= 0.08D").selectExpr(
        "'caller_2' AS tool", "CAST(l_orderkey AS STRING) AS key", "1e0D AS prob"
    )
    return model.unionByName(first).unionByName(second)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_universe(truth(spark, sf_dir), calls(spark, sf_dir), TOOLS)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that still need normalising; source 0 holds the negatives."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CONCAT('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chrom",
        "l_partkey * 10 + l_linenumber AS pos",
        "SUBSTR('acgt', CAST(l_linenumber % 4 + 1 AS INT), 1) AS ref",
        "CONCAT(SUBSTR('CGTA', CAST(l_linenumber % 4 + 1 AS INT), 1), "
        "CASE WHEN l_orderkey % 7 = 0 THEN ',T' ELSE '' END) AS alt",
        "CAST(l_returnflag = 'R' AS INT) AS label",
        "CAST(l_returnflag = 'R' AS INT) AS src_rank",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one repeated base, aligned without gaps."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 22).cast("string").alias("chrom"),
        F.col("l_partkey").alias("start"),
        F.array(F.struct(F.lit("M").alias("op"), F.col("l_quantity").cast("int").alias("len"))).alias("cigar"),
        F.expr("REPEAT(SUBSTR('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1), CAST(l_quantity AS INT))").alias("seq"),
        F.lit(None).cast("array<int>").alias("quals"),
        (F.col("l_orderkey") % 60).cast("int").alias("mapq"),
        (F.col("l_linestatus") == "F").alias("is_reverse"),
        F.lit(0).alias("flag"),
    )


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping mates per line item: letters that differ at times, qualities around the floor,
    a deletion in the second, duplicates flagged."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey % 22 AS STRING) AS chrom",
        "CONCAT_WS(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS name",
        "CAST(l_partkey AS BIGINT) AS at",
        "CAST(l_quantity AS INT) AS size",
        "CAST(l_orderkey AS BIGINT) AS o",
        "CAST(l_linenumber AS INT) AS i",
        "CAST(l_suppkey AS BIGINT) AS s",
    )
    half = "CAST(GREATEST(1, size DIV 2) AS INT)"
    first = rows.selectExpr(
        "chrom",
        "name",
        "at AS start",
        "ARRAY(STRUCT('M' AS op, size AS len)) AS cigar",
        "REPEAT(SUBSTR('ACGT', CAST(o % 4 + 1 AS INT), 1), size) AS seq",
        "ARRAY_REPEAT(10 + i, size) AS quals",
        "CAST(o % 60 AS INT) AS mapq",
        "false AS is_reverse",
        "64 + IF(o % 20 = 0, 1024, 0) AS flag",
    )
    second = rows.selectExpr(
        "chrom",
        "name",
        "at + size DIV 3 AS start",
        f"ARRAY(STRUCT('M' AS op, {half} AS len), STRUCT('D' AS op, 2 AS len), STRUCT('M' AS op, size - {half} AS len)) AS cigar",
        "REPEAT(SUBSTR('ACGT', CAST((o + s % 2) % 4 + 1 AS INT), 1), size) AS seq",
        "ARRAY_REPEAT(CAST(10 + at % 7 AS INT), size) AS quals",
        "CAST(o % 60 AS INT) AS mapq",
        "true AS is_reverse",
        "128 AS flag",
    )
    return first.unionByName(second)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS key",
        "CAST(p_partkey % 22 AS STRING) AS chrom",
        "p_partkey + 1 AS pos",
        "SUBSTR('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS alt",
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 22 AS STRING) AS chrom",
        "o_orderkey AS start",
        "o_orderkey + 3 AS `end`",
        "CAST(o_custkey AS DOUBLE) AS value",
    )


def calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns callers write, before any score is chosen."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id",
        "l_linenumber AS rn",
        "CASE WHEN l_orderkey % 11 = 0 THEN 'x' ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) END "
        "AS tlod",
        "CAST(l_quantity AS BIGINT) AS t_ref_count",
        "CAST(l_linenumber AS BIGINT) - 1 AS t_alt_count",
        "CONCAT(CAST(CAST(l_quantity AS BIGINT) AS STRING), ',', CAST(l_linenumber AS STRING)) AS ad",
        "CAST(l_quantity AS BIGINT) AS qual",
        "CASE WHEN l_returnflag = 'N' THEN 'PASS' ELSE 'weak' END AS filter",
    )


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele fraction and depth per key."""
    return (
        calls_raw(spark, sf_dir)
        .groupBy(F.col("id").cast("string").alias("key"))
        .agg(F.sum("t_ref_count").alias("ref_count"), F.sum("t_alt_count").alias("alt_count"))
        .select(
            "key",
            F.try_divide(F.col("alt_count").cast("double"), F.col("ref_count") + F.col("alt_count")).alias("vaf_est"),
            (F.col("ref_count") + F.col("alt_count")).cast("double").alias("depth_est"),
        )
    )


def info_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call lines with an INFO field that has the fraction under its own or a misleading name."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type = 'click' THEN '.' ELSE CAST(user_id AS STRING) END AS qual",
        "CONCAT('DP=1;', CASE event_type WHEN 'error' THEN 'MAF=0.2;AF=' WHEN 'view' THEN 'X=' ELSE 'AF=' END, "
        "CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING)) AS info",
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS contig", "text")


def contig_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per order, anywhere in a text or a little behind its end; some texts do not exist."""
    documents = table(spark, sf_dir, "documents")
    sizes = documents.select("doc_id", F.length("text").alias("size"))
    many = documents.agg(F.count(F.lit(1))).scalar()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % (many + 5)).alias("doc_id"))
    return orders.join(sizes, "doc_id", "left").select(
        F.col("o_orderkey").alias("site"),
        F.col("doc_id").cast("string").alias("contig"),
        (1 + F.col("o_orderkey") * 7919 % (F.coalesce("size", F.lit(0)) + 20)).alias("pos"),
    )


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers per line item, and a label they decide but for a term of its own."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CONCAT(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS key",
        "ARRAY(CAST(CAST(l_quantity AS BIGINT) AS DOUBLE), CAST(l_partkey % 40 AS DOUBLE), "
        "CAST(CAST(l_returnflag = 'R' AS INT) AS DOUBLE)) AS features",
        "CAST(CAST(l_quantity AS BIGINT) + l_partkey % 40 + 10 * CAST(l_returnflag = 'R' AS INT) "
        "+ l_suppkey % 30 > 62 AS INT) AS label",
    )


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS index", "CAST(event_type = 'error' AS INT) AS label", "value"
    )


def _extra_lines(spark: SparkSession, sf_dir: str, lines: dict[str, str]) -> DataFrame:
    """Lines that stand once in a file: ``file`` -> text, cut at line feeds."""
    one = table(spark, sf_dir, "region").filter("r_regionkey = 0")
    pairs = F.array(*[F.struct(F.lit(text).alias("line"), F.lit(file).alias("file")) for file, text in lines.items()])
    spread = one.select(F.inline(pairs))
    return spread.select(F.explode(F.split("line", "\n")).alias("line"), "file")


def maf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants(spark, sf_dir).withColumn("build", F.when(F.col("pos") % 5 == 0, "GRCh37").otherwise("GRCh38"))
    orders = {
        "a": ("chrom", "pos", "ref", "alt", "build"),
        "b": ("build", "alt", "chrom", "label", "ref", "pos"),
    }
    parts = [
        rows.filter(F.col("pos") % 2 == k).select(
            F.concat_ws("\t", *[F.col(c).cast("string") for c in order]).alias("line"), F.lit(file).alias("file")
        )
        for k, (file, order) in enumerate(orders.items())
    ]
    heads = {
        "a": "#version 2.4\nChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\tNCBI_Build\r",
        "b": "# other\nNCBI_Build\tTumor_Seq_Allele2\tChromosome\tExtra\tReference_Allele\tStart_Position",
    }
    return _extra_lines(spark, sf_dir, heads).unionByName(parts[0]).unionByName(parts[1])


def truth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."))
    rows = variants(spark, sf_dir).select(fields.alias("line"), F.lit("t").alias("file"))
    return _extra_lines(spark, sf_dir, {"t": "##fileformat\n#CHROM\tPOS\n"}).unionByName(rows)


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call lines of which some are short, some have a bad position and some a bad score text."""
    raw = calls_raw(spark, sf_dir)
    whole = F.concat_ws(
        "\t",
        F.concat(F.lit("chr"), (F.col("id") % 22).cast("string")),
        F.when(F.col("id") % 17 == 0, "p").otherwise(F.col("rn").cast("string")),
        F.lit("."),
        F.lit("A"),
        F.when(F.col("id") % 3 == 0, "C,G").otherwise("C"),
        F.lit("."),
        F.col("filter"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("AF="), "tlod", F.lit(","), F.col("rn").cast("string"))).otherwise(
            F.concat(F.lit("AF="), "tlod")
        ),
    )
    line = F.when(F.col("id") % 13 == 0, F.substring_index(whole, "\t", 5)).otherwise(whole)
    return raw.select(line.alias("line"), F.lit("calls").alias("file"))


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences in three files; a split of a file holds a few documents, or part of one."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" x\n"), "text"), "\n")).alias("i", "line")
    )
    return lines.select(
        "line",
        (F.col("doc_id") % 3).cast("string").alias("file"),
        (F.col("doc_id") * 100_000 + F.floor(F.col("i") / 4)).alias("block"),
        F.col("i").cast("bigint").alias("at"),
    )

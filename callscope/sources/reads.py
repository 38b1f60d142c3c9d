"""Aligned reads stored by region, and region access that opens only the files it needs.

A read is filed under the smallest of five nested kinds of bins that holds it whole; one that fits in
none is filed under a bin of its own kind, which every request reads. So a read is stored once, and a
site asks for one bin of each kind. Files are laid out by chromosome and bin. A request joins the
store with the distinct bins of its sites. Up to ``NAMED_BINS`` of them also become a filter on the folders'
names, so that no other folder is listed or opened, in place of the join; a request for more bins scans the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.regions import reference_end
from callscope.sources.batches import read_schema, write_schema

#: Letters in a bin of each kind, as powers of two; the last number stands for reads that fit in none.
KINDS = (17, 20, 23, 26, 29)
UNBOUND = 0
#: Bins of a request that are named in the scan; the driver sees no more than that.
NAMED_BINS = 10_000
#: Reads that one task sorts and writes.
TASK_READS = 250_000
#: Numbers of bins of one kind begin at the kind's number times this.
KIND = 1 << 40


def bin_of(start: Column, end: Column) -> Column:
    """The smallest bin that holds the letters [start, end) whole."""
    found = F.lit(UNBOUND).cast("bigint")
    for k, bits in reversed(list(enumerate(KINDS, 1))):
        low, high = F.shiftright(start, bits), F.shiftright(F.greatest(end - 1, start), bits)
        found = F.when(low == high, low + k * KIND).otherwise(found)
    return found


def bins_at(place: Column) -> Column:
    """All bins that can hold a read over a place (0-based)."""
    return F.array(F.lit(UNBOUND).cast("bigint"), *[F.shiftright(place, bits) + k * KIND for k, bits in enumerate(KINDS, 1)])


def write_reads(reads: DataFrame, folder: str) -> None:
    """Write reads by (chrom, bin), sorted by start; a bin of many reads is written by several tasks.

    ``reads`` as for ``regions.pileup``, with any other columns. Reads without chromosome or start lie nowhere and are left out.
    """
    placed = reads.filter(F.col("chrom").isNotNull() & F.col("start").isNotNull())
    start = F.col("start").cast("bigint")
    binned = placed.withColumn("bin", bin_of(start, reference_end(start, F.coalesce("cigar", F.array().cast(reads.schema["cigar"].dataType)))))
    order = ["chrom", "bin", "start"]
    parts = max(1, -(-placed.count() // TASK_READS))
    dealt = binned.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("chrom", "bin").parquet(f"{folder}/rows")
    write_schema(dealt.select(*[c for c in dealt.columns if c not in ("chrom", "bin")], F.col("chrom").cast("string"), "bin"), folder)


def read_regions(spark: SparkSession, folder: str, sites: DataFrame) -> DataFrame:
    """The stored reads of all bins that touch a site: every read over a site, and others near it.

    ``sites``: chrom, pos (1-based). Sites without a place ask for nothing.
    """
    reads = spark.read.schema(read_schema(spark, folder)).parquet(f"{folder}/rows")
    place = F.col("pos").cast("bigint") - 1
    wanted = sites.filter(F.col("pos") > 0).select(F.col("chrom").cast("string").alias("chrom"), F.explode(bins_at(place)).alias("bin"))
    wanted = wanted.distinct()
    named = wanted.take(NAMED_BINS + 1)
    if len(named) <= NAMED_BINS:
        by_chrom: dict[str, list[int]] = {}
        for chrom, number in named:
            by_chrom.setdefault(chrom, []).append(number)
        own = [(F.col("chrom") == chrom) & F.col("bin").isin(numbers) for chrom, numbers in by_chrom.items()]
        return reads.filter(reduce(lambda a, b: a | b, own, F.lit(False))).drop("bin")  # which names them all
    return reads.join(wanted, ["chrom", "bin"], "left_semi").drop("bin")

"""Rows stored in order, read back by row range; scoring in batches that can stop and go on.

File K of a store holds the rows [K * file_rows, (K + 1) * file_rows) in their order, and a manifest
says so, one line per file. A range of rows opens the files it meets and no other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from callscope.session import durable

FILE_ROWS = 100_000
ROW = "row"
MANIFEST = "file bigint, first bigint, rows bigint"


def numbered(rows: DataFrame, order: Sequence[str], name: str = ROW, part_rows: int = FILE_ROWS) -> DataFrame:
    """Number all rows 0, 1, 2, ... in ``order``, which must tell rows apart (others come in any order).

    Rows are sorted in parts of counted size; the numbers of a part begin behind those before it.
    """
    kept = durable(rows)
    parts = max(1, -(-kept.count() // part_rows))
    # Stored, since the bounds of parts come from a sample and counts and numbers need the same ones.
    placed = durable(kept.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    joined = placed.withColumn("_at", inside).join(offsets, "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def write_ordered(rows: DataFrame, folder: str, order: Sequence[str], file_rows: int = FILE_ROWS) -> None:
    """Write rows in ``order`` as a store of files of ``file_rows`` rows, with column ``row``."""
    placed = numbered(rows, order, ROW, file_rows).withColumn("file", F.floor(F.col(ROW) / file_rows).cast("bigint"))
    dealt = durable(placed).repartition("file").sortWithinPartitions("file", ROW)
    dealt.write.mode("overwrite").partitionBy("file").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    write_schema(placed.drop("file"), folder)
    files = _rows(spark, folder).groupBy("file").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("rows"))
    files.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a store with the number of their file, which is a column of its folders."""
    return spark.read.schema(read_schema(spark, folder).add("file", LongType())).parquet(f"{folder}/rows")


def write_schema(frame: DataFrame, folder: str) -> None:
    """Store the columns beside the rows: a store without rows has no file to tell them, and none need be opened."""
    row = frame.sparkSession.createDataFrame([(frame.schema.json(),)], "fields string")
    row.write.mode("overwrite").parquet(f"{folder}/schema")


def read_schema(spark: SparkSession, folder: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/schema").first()["fields"]))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file, first, rows`` of a store."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_range(spark: SparkSession, folder: str, first: int = 0, stop: int | None = None) -> DataFrame:
    """Rows [first, stop) of a store; only the files that hold them are listed in the scan."""
    met = F.col("first") + F.col("rows") > first
    if stop is not None:
        met &= F.col("first") < stop
    bounds = manifest(spark, folder).filter(met).agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    stored = _rows(spark, folder)
    if bounds["low"] is None:
        return stored.limit(0).drop("file")
    near = stored.filter(F.col("file").between(bounds["low"], bounds["high"]))
    return near.filter((F.col(ROW) >= first) & (F.lit(True) if stop is None else F.col(ROW) < stop)).drop("file")


def _done(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def score_batches(
    spark: SparkSession, folder: str, output: str, score: Callable[[DataFrame], DataFrame], files: int = 16
) -> DataFrame:
    """Score a store, ``files`` files at a time, each batch into a folder of its own below ``output``.

    A batch whose folder is complete is not scored again, so a run that died goes on where it stopped. Batches
    are counted from the manifest alone. ``score`` maps rows to rows and must not need other batches.
    """
    last = manifest(spark, folder).agg(F.max("file")).first()[0]
    done = []
    for batch in range(0 if last is None else last // files + 1):
        target = f"{output}/batch={batch}"
        if not _done(spark, target):
            rows = _rows(spark, folder).filter(F.col("file").between(batch * files, (batch + 1) * files - 1))
            score(rows.drop("file")).write.mode("overwrite").parquet(target)
        done.append(target)
    if not done:
        return score(_rows(spark, folder).drop("file")).limit(0)
    return spark.read.parquet(*done)

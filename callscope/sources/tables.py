"""Delimited tables: predictions, calls, evidence, signals, truth; Parquet stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.keys import variant_key
from callscope.operators.align import truth_labels
from callscope.sources import schemas
from callscope.sources.columns import LABEL_SYNONYMS, SYNONYMS, require_columns, resolve_columns

BYTE_ORDER_MARK = "﻿"


def _without_mark(frame: DataFrame) -> DataFrame:
    """Drop the byte order mark some writers put before the first column name."""
    return frame.toDF(*[c.replace(BYTE_ORDER_MARK, "") for c in frame.columns])


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header. Columns are matched by name, so files may order them differently.

    Without a schema all columns stay text (no extra pass over the data to guess types).
    """
    frame = _without_mark(spark.read.csv(path, header=True))
    if schema is None:
        return frame
    wanted = spark.createDataFrame([], schema).schema
    require_columns(frame, wanted.names)
    return frame.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Positional predictions; the header must begin with index, label, prob, pred_0.5."""
    frame = _without_mark(spark.read.csv(path, header=True))
    require_columns(frame, ["index", "label", "prob", "pred_0.5"], exact_order=True)
    return read_table(spark, path, schemas.PREDICTIONS).withColumnRenamed("pred_0.5", "pred_05")


def read_keyed_predictions(spark: SparkSession, path: str) -> DataFrame:
    frame = _without_mark(spark.read.csv(path, header=True))
    require_columns(frame, ["key", "prob"])
    return frame.select("key", F.col("prob").try_cast("double").alias("prob"))


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """Signal per window: tab-separated, no header."""
    return spark.read.csv(path, sep="\t", schema=schemas.SIGNAL)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Read evidence; text in a numeric column counts as missing."""
    return read_table(spark, path, schemas.EVIDENCE)


def load_truth(frame: DataFrame, conflict: str = "first") -> DataFrame:
    """``key, label`` from a labelled variant table under any of the known column names.

    The key that comes with two labels is decided by ``src_rank`` if the table has it; tables
    without it list negatives first, so label 0 counts as the earlier source.
    """
    wanted = {**SYNONYMS, "label": LABEL_SYNONYMS}
    rows = resolve_columns(frame, wanted)
    rank = F.col("src_rank") if "src_rank" in frame.columns else None
    if rank is not None:
        rows = resolve_columns(frame, {**wanted, "src_rank": ("src_rank",)})
    keyed = rows.select(
        variant_key().alias("key"),
        F.col("label").cast("int").alias("label"),
        (F.col("src_rank").cast("bigint") if rank is not None else F.col("label").cast("bigint")).alias("src_rank"),
    )
    return truth_labels(keyed, conflict)


def with_row_number(frame: DataFrame, name: str = "row") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... in scan order.

    Only for a frame fresh from a file reader: rows are numbered inside their partition, and
    partition sizes are added up over partitions (a table with one row per partition). A scan
    cuts files the same way each time, so a retry gives the same numbers.
    """
    marked = frame.withColumn("_at", F.monotonically_increasing_id())
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = marked.withColumns({"_part": F.shiftright("_at", 33), "_within": within})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before")
    )
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop(
        "_at", "_part", "_within", "_before"
    )


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature store: Parquet, one folder per label so that class-wise readers skip the rest."""
    features.write.mode(mode).partitionBy("y").parquet(path)


def read_features(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame if label is None else frame.filter(F.col("y") == label)

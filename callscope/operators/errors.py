"""The worst mistakes of every tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.keys import split_key
from callscope.operators.ordered import with_cells
from callscope.session import durable

#: Rows that one task ranks, as counted rows are dealt.
PART_ROWS = 1_000_000


def _reach(cells: DataFrame, group: list[str], cell: str, n: int) -> DataFrame:
    """Per group the first cell up to which ``n`` rows lie (the last one if there are fewer), and the rows before it.

    ``cells``: group, cell, ``_n`` rows, ``_before`` rows ahead of all cells of the group.
    """
    order = Window.partitionBy(*group).orderBy(cell)
    upto = F.col("_before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = cells.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") < n)
    return reached.groupBy(*group).agg(F.max(cell).alias(cell), F.max(F.col("_upto") - F.col("_n")).alias("_before"))


def _select(rows: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """Rows of each group among which its ``n`` least values are: all up to the fine cell of rank n.

    Only counts of cells are ordered. The cells reached are one row per group, which is broadcast.
    """
    # Missing values stand in the lowest cell.
    celled = with_cells(rows.withColumn("_v", F.coalesce(value, F.lit(float("-inf")))), "_v").drop("_v")
    zero = F.lit(0).cast("bigint").alias("_before")
    coarse = celled.groupBy(*group, "_coarse").agg(F.count(F.lit(1)).alias("_n")).select("*", zero)
    first = F.broadcast(_reach(coarse, group, "_coarse", n).withColumnRenamed("_coarse", "_c"))
    near = celled.join(first, group).filter(F.col("_coarse") <= F.col("_c"))
    fine = near.filter(F.col("_coarse") == F.col("_c")).groupBy(*group, "_fine", "_before").agg(F.count(F.lit(1)).alias("_n"))
    second = F.broadcast(_reach(fine, group, "_fine", n).select(*group, F.col("_fine").alias("_f")))
    inside = (F.col("_coarse") < F.col("_c")) | (F.col("_fine") <= F.col("_f"))
    return near.drop("_before").join(second, group).filter(inside).drop("_coarse", "_fine", "_c", "_f")


def _ranked(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Add ``rank`` from 1 inside each group and keep the first ``n``: rows are sorted in parts of counted size, ties of a value
    by the next column of ``order``, and a part's ranks begin behind the rows of the parts before."""
    kept = durable(rows)
    parts = max(1, -(-kept.count() // PART_ROWS))
    ranged = kept.repartitionByRange(parts, *group, *order)
    # Stored, since the bounds come from a sample and counts and ranks need the same ones.
    placed = durable(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    # What is not among the first n of its part is not among the first n.
    first = placed.withColumn("_at", inside).filter(F.col("_at") <= n)
    ranked = first.join(offsets, [*group, "_part"]).withColumn("rank", (F.col("_before") + F.col("_at")).cast("int"))
    return ranked.filter(F.col("rank") <= n).drop("_part", "_at", "_before")


def top_errors(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` highest-scored negatives (FP) and lowest-scored positives (FN) per tool.

    No threshold is applied. Ties are decided by the key; missing scores come first. Counts of score
    cells find the cell that holds rank ``n``; only rows up to there are sorted, in parts of counted
    size, so the plan is the same for any ``n`` and for scores that many rows share.
    """
    wrongness = F.when(F.col("label") == 0, -F.col("prob")).otherwise(F.col("prob"))
    usable = scored.filter(F.col("label").isin(0, 1)).withColumn("_w", wrongness)
    group = ["tool", "label"]
    worst = _ranked(_select(usable, group, "_w", n), group, ["_w", "key"], n)
    return worst.select(
        "tool",
        F.when(F.col("label") == 0, "FP").otherwise("FN").alias("err"),
        "rank",
        "key",
        *split_key("key"),
        "prob",
        "label",
    )


def loci(errors: DataFrame) -> DataFrame:
    """``chrom:pos-pos`` of every error whose key holds a position."""
    return errors.filter(F.col("pos").isNotNull()).select(
        "tool", "err", "rank", F.format_string("%s:%d-%d", "chrom", "pos", "pos").alias("locus")
    )

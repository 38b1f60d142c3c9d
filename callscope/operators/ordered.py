"""Running totals, ranks and exact quantiles over ordered values, without a global sort.

``sum().over(partitionBy(tool).orderBy(score))`` sends all rows of a tool to one task. Here the
value axis is cut into cells, totals per cell are added up first, and the window that sorts
values runs inside one cell only:

1. cells follow the binary form of a double: exponent and nine further bits, counted from 0 below
   one half and from 1 above it, so that scores piling up at either end spread over many cells.
   They depend on nothing but the value, so a retried task sees the same cells.
2. every cell is cut again by the next 21 bits, so a group has at most about two million cells per
   step and 2^22 values inside a fine cell.
3. the total of everything before a cell enters the next window as an extra first row of that
   cell, so no join and no broadcast is needed.

Rows must be collapsed to one per (group, value) beforehand; ``histogram`` does that with
map-side partial aggregation, which is also what absorbs a value shared by a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_BITS = 9
FINE_BITS = 21
LOWEST_EXPONENT = -1000
LARGEST = 1e300

# Running totals read their input several times. Spark reuses the shuffle behind it; a caller may
# instead pass a function that stores the (small) counts, such as ``session.durable``.
Cut = Callable[[DataFrame], DataFrame]


def uncut(frame: DataFrame) -> DataFrame:
    return frame


def with_cells(values: DataFrame, value: str) -> DataFrame:
    """Add BIGINT cell numbers ``_coarse`` and ``_fine``; as a pair non-decreasing in ``value``.

    One projection per step: each step uses its input more than once, and written as a single
    expression the generated method would outgrow what the JVM compiles.
    """
    # Infinities share the outermost cells with the largest numbers.
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    upper = (v > 0.5) & (v < 1.0)
    # Cell of 1.0: as far above the cell of one half as that is above the cell of 0.
    one = -2 * LOWEST_EXPONENT * (1 << COARSE_BITS)
    return (
        values.withColumn("_size", F.when(upper, 1.0 - v).otherwise(F.abs(v)))
        .withColumn("_exp", F.greatest(F.floor(F.log2("_size")), F.lit(LOWEST_EXPONENT)).cast("double"))
        .withColumn("_steps", (F.col("_size") * F.pow(F.lit(2.0), -F.col("_exp")) - 1.0) * float(1 << COARSE_BITS))
        .withColumns(
            {
                "_whole": F.floor("_steps"),
                "_sign": F.when((v < 0) | upper, -1).when((v == 0) | (v == 1), 0).otherwise(1),
                "_base": F.when(v > 0.5, one).otherwise(0).cast("bigint"),
            }
        )
        .withColumns(
            {
                "_coarse": F.col("_base")
                + F.col("_sign")
                * ((F.col("_exp") - float(LOWEST_EXPONENT - 1)) * float(1 << COARSE_BITS) + F.col("_whole")).cast("bigint"),
                "_fine": F.col("_sign")
                * F.floor((F.col("_steps") - F.col("_whole")) * float(1 << FINE_BITS)).cast("bigint"),
            }
        )
        .drop("_size", "_exp", "_steps", "_whole", "_sign", "_base")
    )


def running_totals(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``<m>_cum`` (inclusive running total) and ``<m>_all`` (group total) per measure.

    ``values`` holds one row per (group, value).
    """
    group, measures = list(group), list(measures)
    cells = with_cells(values.select(*group, value, *measures), value)
    rows = cells.select(*group, value, *measures, F.col("_coarse").alias("_c1"), F.col("_fine").alias("_c2"))

    def order(name: str) -> Column:
        return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_first()

    totals = rows.groupBy(*group, "_c1").agg(*[F.sum(m).alias(m) for m in measures])

    # What lies before each coarse cell: one window row per cell.
    whole = Window.partitionBy(*group).orderBy(order("_c1"))
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = totals.select(
        *group,
        "_c1",
        *[F.coalesce(F.sum(m).over(before), F.lit(0).cast("bigint")).alias(m) for m in measures],
        *[F.sum(m).over(everything).alias(f"{m}_all") for m in measures],
    )
    # What lies before each fine cell: the coarse offset leads the fine totals of its cell.
    fine_totals = rows.groupBy(*group, "_c1", "_c2").agg(*[F.sum(m).alias(m) for m in measures])
    inside = Window.partitionBy(*group, "_c1").orderBy(order("_c2"))
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = (
        ahead
        .unionByName(fine_totals, allowMissingColumns=True)
        .select(
            *group,
            "_c1",
            "_c2",
            *[F.sum(m).over(prior).alias(m) for m in measures],
            *[F.max(f"{m}_all").over(upto).alias(f"{m}_all") for m in measures],
        )
        .filter(F.col("_c2").isNotNull())
    )
    # The values themselves, behind the offset of their fine cell.
    inside = Window.partitionBy(*group, "_c1", "_c2").orderBy(order(value))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ahead.unionByName(rows, allowMissingColumns=True)
        .select(
            *group,
            value,
            *measures,
            *[F.sum(m).over(upto).alias(f"{m}_cum") for m in measures],
            *[F.max(f"{m}_all").over(upto).alias(f"{m}_all") for m in measures],
        )
        .filter(F.col(value).isNotNull())
    )


def histogram(frame: DataFrame, group: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """One row per (group, value) with its row count; missing values are left out."""
    v = F.col(value).cast("double")
    return (
        frame.select(*group, v.alias(value))
        .filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias(count))
    )


def rank_position(fraction: float, count) -> Column:
    """Real-valued rank of a quantile among ``count`` ordered rows, counted from 0."""
    return (F.col(count) if isinstance(count, str) else count).cast("double").__sub__(1.0) * F.lit(float(fraction))


def quantiles(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
    count: str = "n",
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Picks the two neighbouring order statistics of every quantile from the running totals, so
    memory does not grow with the number of distinct values as it does in ``percentile``.
    """
    ranked = running_totals(values, group, value, [count])
    first = F.col(f"{count}_cum") - F.col(count)
    picks = []
    for fraction, name in zip(fractions, names):
        low = F.floor(rank_position(fraction, f"{count}_all"))
        high = F.ceil(rank_position(fraction, f"{count}_all"))
        picks += [
            F.max(F.when((first <= low) & (low < F.col(f"{count}_cum")), F.col(value))).alias(f"_{name}_low"),
            F.max(F.when((first <= high) & (high < F.col(f"{count}_cum")), F.col(value))).alias(f"_{name}_high"),
        ]
    picked = ranked.groupBy(*group).agg(
        F.max(f"{count}_all").alias(f"{count}"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        *picks,
    )
    results = []
    for fraction, name in zip(fractions, names):
        share = rank_position(fraction, count) - F.floor(rank_position(fraction, count))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((low + (high - low) * share).alias(name))
    return picked.select(*group, count, "lowest", "highest", *results)


def dense_index(frame: DataFrame, group: Sequence[str], key: str, index: str = "idx") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order of md5(key), then key.

    ``key`` must be unique within the group. Cells are hash prefixes and therefore even, whatever
    the keys look like; a million of them keeps each sort group small up to 10^12 rows. Adds
    ``<index>_size``, the group's row count.
    """
    group = list(group)
    rows = frame.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn(
        "_c", F.conv(F.substring("_h", 1, 5), 16, 10).cast("bigint")
    )
    cells = rows.groupBy(*group, "_c").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group).orderBy("_c")
    offsets = cells.select(
        *group,
        "_c",
        F.coalesce(
            F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
        ).alias("_n"),
        F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(
            f"{index}_size"
        ),
    )
    stacked = offsets.unionByName(rows.withColumn("_n", F.lit(1).cast("bigint")), allowMissingColumns=True)
    scope = Window.partitionBy(*group, "_c").orderBy(F.col("_h").asc_nulls_first(), F.col(key).asc_nulls_first())
    upto = scope.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = stacked.withColumn(index, F.sum("_n").over(upto) - 1).withColumn(
        f"{index}_size", F.max(f"{index}_size").over(upto)
    )
    return numbered.filter(F.col("_h").isNotNull()).drop("_h", "_c", "_n")

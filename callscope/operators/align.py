"""Bring calls of several tools onto one labelled universe of keys.

The scored contract used everywhere else: ``key, label, prob, tool`` with (tool, key) unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.numeric import clip, to_number


def max_per_key(calls: DataFrame, keys: Sequence[str] = ("key",), score: str = "prob") -> DataFrame:
    """Highest score per key; missing scores do not win."""
    return calls.groupBy(*keys).agg(F.max(to_number(score)).alias(score))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row of every key under an explicit order.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key
    that holds a large share of the table costs one row per task. ``order`` must decide ties.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def truth_labels(variants: DataFrame, conflict: str = "first") -> DataFrame:
    """One label per key out of labelled rows ``key, label, src_rank``.

    ``conflict`` says what a key with both labels gets: ``first`` the label of the source that
    comes first (in it, the lower label), ``positive`` 1, ``drop`` no row at all.
    """
    label = F.col("label").cast("int")
    rows = variants.select("key", label.alias("label"), F.col("src_rank").cast("bigint").alias("src_rank"))
    if conflict == "first":
        # One BIGINT as order keeps this a hash aggregate.
        return rows.groupBy("key").agg(F.min_by("label", F.col("src_rank") * 2 + F.col("label")).alias("label"))
    spread = rows.groupBy("key").agg(F.max("label").alias("label"), F.min("label").alias("_low"))
    if conflict == "positive":
        return spread.drop("_low")
    if conflict == "drop":
        return spread.filter(F.col("label") == F.col("_low")).drop("_low")
    raise ValueError(f"conflict must be first, positive or drop, not {conflict!r}")


def label_conflicts(variants: DataFrame) -> DataFrame:
    """Keys labelled both ways, with the number of rows on each side."""
    return (
        variants.groupBy("key")
        .agg(
            F.count_if(F.col("label") == 0).alias("negatives"),
            F.count_if(F.col("label") == 1).alias("positives"),
        )
        .filter((F.col("negatives") > 0) & (F.col("positives") > 0))
    )


def merge_labelled(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Stack both sources; ``label`` and ``src_rank`` record where a row came from."""

    def ranked(frame: DataFrame, label: int, rank: int) -> DataFrame:
        return frame.drop("label", "src_rank").withColumns(
            {"label": F.lit(label), "src_rank": F.lit(rank)}
        )

    return ranked(negatives, 0, 0).unionByName(ranked(positives, 1, 1))


def universe_wide(
    truth: DataFrame,
    calls: DataFrame,
    tools: Sequence[str],
    pick: str = "max",
    order: Column | str | None = None,
    missing: float = 0.0,
) -> DataFrame:
    """``key, label, scores`` with one array entry (tool, prob) per tool.

    Calls are reduced to one row per key - all tools side by side - before the only join, so
    truth is read and shuffled once, whatever the number of tools. ``pick`` chooses among
    several calls of a tool on a key: ``max``, or ``first`` under the single column ``order``.
    """
    score = to_number("prob")
    per_tool = []
    for i, tool in enumerate(tools):
        mine = F.col("tool") == tool
        if pick == "max":
            best = F.max(F.when(mine, score))
        elif pick == "first" and order is not None:
            rank = F.col(order) if isinstance(order, str) else order
            best = F.min_by(score, F.when(mine, rank))
        else:
            raise ValueError("pick must be max, or first together with order")
        per_tool.append(best.alias(f"_p{i}"))
    by_key = calls.filter(F.col("tool").isin(list(tools))).groupBy("key").agg(*per_tool)
    entries = [
        F.struct(
            F.lit(tool).alias("tool"),
            clip(F.coalesce(F.col(f"_p{i}"), F.lit(float(missing))), 0.0, 1.0).alias("prob"),
        )
        for i, tool in enumerate(tools)
    ]
    return truth.select("key", "label").join(by_key, "key", "left").select(
        "key", "label", F.array(*entries).alias("scores")
    )


def melt_scores(wide: DataFrame) -> DataFrame:
    """Long form of ``universe_wide``: one row per (tool, key)."""
    return wide.select("key", "label", F.inline("scores")).select("key", "label", "prob", "tool")


def align_universe(truth, calls, tools, pick="max", order=None, missing=0.0) -> DataFrame:
    """Every truth key once per tool; a key the tool did not call scores ``missing``."""
    return melt_scores(universe_wide(truth, calls, tools, pick, order, missing))


def label_calls(calls: DataFrame, truth: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep every call, add the label where truth knows the key; one row per (key, tool).

    Reduced to one row per (key, tool) first: a key with very many calls never meets the join.
    """
    single = first_per_key(calls, ["key", "tool"], order)
    return single.join(truth.select("key", "label"), "key", "left")


def clean_by_key(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Best score per key for the keys truth knows, with the label of truth."""
    return max_per_key(predictions).join(truth.select("key", "label"), "key", "inner")


def keys_without_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """The keys ``clean_by_key`` leaves out."""
    return predictions.select("key").join(truth.select("key"), "key", "left_anti").distinct()


def drop_unlabelled(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label."""
    return rows.filter(F.col(label).isNotNull())


def unlabelled_report(rows: DataFrame, label: str = "label") -> DataFrame:
    """How many rows there are and how many of them ``drop_unlabelled`` leaves out."""
    # Not an Observation: once a session has used one, Spark 4.1 fails to ship fitted
    # logistic models to its tasks.
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).isNull()).alias("unlabelled"))


def paired_scores(scored: DataFrame, tool_a: str, tool_b: str) -> DataFrame:
    """``key, label, prob_a, prob_b``; fails if one of the tools lacks a key.

    One aggregation over the key instead of a self join.
    """
    side_a, side_b = F.col("tool") == tool_a, F.col("tool") == tool_b
    paired = (
        scored.filter(side_a | side_b)
        .groupBy("key")
        .agg(
            F.max("label").alias("label"),
            F.max(F.when(side_a, F.col("prob"))).alias("prob_a"),
            F.max(F.when(side_b, F.col("prob"))).alias("prob_b"),
        )
    )

    def present(name: str) -> Column:
        message = F.concat(F.lit("keys not aligned between tools: "), F.col("key"))
        return F.when(F.col(name).isNull(), F.raise_error(message).cast("double")).otherwise(F.col(name)).alias(name)

    return paired.select("key", "label", present("prob_a"), present("prob_b"))


def cyclic_zip(
    predictions: DataFrame,
    mapping: DataFrame,
    index: str = "index",
    row: str = "row",
    on_mismatch: str = "error",
) -> DataFrame:
    """Give prediction ``i`` the mapping row ``i mod L``.

    Both sides carry explicit row numbers. A length mismatch is an error unless
    ``on_mismatch='cycle'``; an empty mapping always is one. The lengths are scalar subqueries.
    """
    length = F.count(F.lit(1))
    checked = F.when(length == 0, F.raise_error(F.lit("the mapping is empty")).cast("bigint")).otherwise(length)
    if on_mismatch == "error":
        rows = predictions.agg(F.count(F.lit(1))).scalar()
        checked = F.when(
            rows != length, F.raise_error(F.lit("predictions and mapping differ in length")).cast("bigint")
        ).otherwise(checked)
    elif on_mismatch != "cycle":
        raise ValueError("on_mismatch must be error or cycle")
    # A left join: with an inner one an empty mapping would end the query before the check is read.
    size = mapping.agg(checked.alias("_size")).scalar()
    keyed = predictions.withColumn("_row", F.pmod(F.col(index).cast("bigint"), size))
    return keyed.join(mapping.withColumnRenamed(row, "_row"), "_row", "left").drop("_row")


def calls_only_in_a(scored: DataFrame, tool_a: str, tool_b: str, threshold: float = 0.5) -> DataFrame:
    """Keys called by ``tool_a`` and not by ``tool_b``."""
    called = scored.filter(F.col("prob") >= threshold)
    return (
        called.filter(F.col("tool") == tool_a)
        .select("key")
        .join(called.filter(F.col("tool") == tool_b).select("key"), "key", "left_anti")
    )


def calls_in_both(scored: DataFrame, tool_a: str, tool_b: str, threshold: float = 0.5) -> DataFrame:
    """Keys called by both tools."""
    called = scored.filter(F.col("prob") >= threshold)
    return (
        called.filter(F.col("tool") == tool_a)
        .select("key")
        .join(called.filter(F.col("tool") == tool_b).select("key"), "key", "left_semi")
    )

"""Splits, balanced and weighted samples, bootstrap intervals.

All draws come from hashed keys (``functions.hashing``): repeatable under retry, independent of
the partition layout, and shared by tools that score the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.hashing import poisson_bounds, unit, with_digest, with_draw, with_index
from callscope.operators.metrics import class_sizes
from callscope.operators.ordered import dense_index
from callscope.operators.replicates import Draws, named_groups, replicate_areas, scored_rows, weight_sums, weighted_areas
from callscope.session import durable, ship

# Seeds and sizes of the resampling steps, interval bounds.
SAMPLE_SEED = 42
BOOTSTRAP_SEED = 123
BOOTSTRAP_REPS = 1000
STRATIFIED_REPS = 200
INTERVAL = (0.025, 0.975)
TRAIN_SHARE = 0.8
#: Standard deviations that stratified weights stay below the class size; draws made by one row.
SPARE = 8.0
DRAWS = 4096


def hash_split(rows: DataFrame, key: str = "key", share: float = TRAIN_SHARE, seed: int = SAMPLE_SEED) -> DataFrame:
    """Add ``split`` (train / validation); all rows of a key land on one side."""
    drawn = with_draw(with_digest(rows, key), "_u", 0, seed)
    side = F.when(unit("_u") < share, "train").otherwise("validation")
    return drawn.withColumn("split", side).drop("_h", "_l", "_u")


def _class_check(rows: DataFrame, like: DataFrame, group: Sequence[str]) -> DataFrame:
    """No rows, or an error if a group lacks a class; stack it onto a result that needs both."""
    counts = rows.groupBy(*group).agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    missing = F.raise_error(F.lit("cannot balance: both classes are needed")).cast("boolean")
    checked = counts.filter(F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.lit(False)).otherwise(missing))
    return checked.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def balanced_sample(
    rows: DataFrame, key: str = "key", seed: int = SAMPLE_SEED, group: Sequence[str] = ()
) -> DataFrame:
    """Per group all positives, and as many negatives drawn with replacement.

    Adds ``draw``: empty for a positive, else the key of the positive the negative was drawn for.
    ``key`` must be unique in its group. Fails if a group lacks a class.
    """
    group = list(group)
    labelled = rows.filter(F.col("label").isin(0, 1))
    positives = labelled.filter(F.col("label") == 1)
    sized = positives.select(*group, F.col(key).cast("string").alias("draw")).withColumn("_sizes", class_sizes(rows, group))
    draws = with_index(with_digest(sized, "draw"), "_idx", 0, seed, F.col("_sizes.n0")).select(*group, "draw", "_idx")
    pool = dense_index(labelled.filter(F.col("label") == 0), group, key, "_idx").drop("_idx_size")
    drawn = draws.join(pool, [*group, "_idx"]).drop("_idx")
    kept = positives.withColumn("draw", F.lit(""))
    return kept.unionByName(drawn.select(*kept.columns)).unionByName(_class_check(rows, kept, group))


def weighted_resample(
    rows: DataFrame, key: str = "key", seed: int = SAMPLE_SEED, group: Sequence[str] = ()
) -> DataFrame:
    """Per group as many rows as given, drawn with replacement, each class with the same total weight.

    A draw picks a class, then a row of it. ``draw`` is the key of the row the draw stands for.
    """
    group = list(group)
    n0, n1 = F.col("_sizes.n0"), F.col("_sizes.n1")
    labelled = rows.filter(F.col("label").isin(0, 1))
    one_class = F.when(n1 == 0, F.lit(0)).when(n0 == 0, F.lit(1))
    sized = labelled.select(*group, F.col(key).cast("string").alias("draw")).withColumn("_sizes", class_sizes(rows, group))
    digested = with_digest(sized, "draw")
    coin = (unit("_u") < 0.5).cast("int")
    picked = with_draw(digested, "_u", 1, seed).withColumn("label", F.coalesce(one_class, coin))
    size = F.when(F.col("label") == 1, n1).otherwise(n0)
    draws = with_index(picked, "_idx", 2, seed, size).select(*group, "draw", "label", "_idx")
    pool = dense_index(labelled.withColumn("label", F.col("label").cast("int")), [*group, "label"], key, "_idx")
    return draws.join(pool.drop("_idx_size"), [*group, "label", "_idx"]).drop("_idx")


def _interval(values: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Base value (rep -1) and interval over the replicates that had both classes.

    The exact ``percentile`` sees at most one value per replicate.
    """
    replicate = F.col("rep") >= 0
    columns = []
    for name in names:
        base = F.max(F.when(~replicate, F.col(name)))
        sampled = F.when(replicate, F.col(name))
        columns.append(base.alias(name))
        for bound, suffix in zip(INTERVAL, ("lo", "hi")):
            columns.append(F.coalesce(F.percentile(sampled, bound), base).alias(f"{name}_{suffix}"))
    used = F.count(F.when(replicate, F.col(names[0]))).alias("reps_used")
    return values.groupBy(*group).agg(*columns, used)


def bootstrap_areas(
    scored: DataFrame,
    reps: int = BOOTSTRAP_REPS,
    seed: int = BOOTSTRAP_SEED,
    group: Sequence[str] = ("tool",),
) -> DataFrame:
    """AUROC and AUPRC per tool with 95 % bootstrap intervals.

    A replicate that lost a class does not count.
    """
    return intervals(replicate_areas(scored, group, reps, seed), group)


def intervals(values: DataFrame, group: Sequence[str] = ("tool",)) -> DataFrame:
    """Intervals of both areas from ``replicate_areas``."""
    return _interval(values, group, ["auroc", "auprc"])


def poisson_mean(size: int) -> float:
    """Mean weight for classes of this size: eight standard deviations below one."""
    return max(0.0, 1.0 - SPARE / size**0.5) if size else 0.0


def bootstrap_stratified(
    scored: DataFrame, reps: int = STRATIFIED_REPS, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """AUROC intervals from resamples that keep both class sizes exactly.

    A replicate draws as many keys of a class as it has, with replacement, and all tools share the
    draws. Given their sum, Poisson weights are such draws. So keys get Poisson weights of a mean a
    little below one, where their rows are; per class and replicate only the sum is needed, and the
    few draws that are missing (in the order of the root of the class size) are drawn one by one
    from the numbered keys. A replicate whose weights exceed the class draws all its keys that way.
    Labels belong to keys, as after ``align_universe``.
    """
    spark = scored.sparkSession
    ship(spark)
    labelled = scored.filter(F.col("label").isin(0, 1))
    pool = durable(labelled.groupBy("key").agg(F.max("label").cast("int").alias("label")))
    sizes = {0: 0, 1: 0} | dict(pool.groupBy("label").count().collect())
    bounds = tuple(poisson_bounds(poisson_mean(sizes[label])) for label in (0, 1))
    draws = Draws(reps, seed, bounds)
    totals = weight_sums(with_digest(pool, "key", ("h", "l")), draws).collect()  # two numbers per replicate
    off = [frozenset(t.rep for t in totals if t.label == label and t.total > sizes[label]) for label in (0, 1)]
    missing = [(t.label, t.rep, sizes[t.label] - (0 if t.rep in off[t.label] else t.total)) for t in totals]
    extra = _drawn(spark.createDataFrame(missing, "label int, rep int, n bigint"), pool, sizes, seed)
    rows = scored_rows(scored, ["tool"])
    keyed = extra.groupBy("key").agg(F.collect_list("rep").alias("extra"))
    again = rows.drop("extra", "h", "l").join(keyed, "key")
    weighed = weighted_areas(rows.unionByName(again, allowMissingColumns=True), replace(draws, off=tuple(off)))
    return _interval(named_groups(weighed, scored, ["tool"]), ["tool"], ["auroc"])


def _drawn(missing: DataFrame, pool: DataFrame, sizes: dict[int, int], seed: int) -> DataFrame:
    """``key, rep``: so many uniform draws from the keys of a class per (label, rep, n)."""
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / DRAWS).cast("bigint")))
    cut = missing.filter("n > 0").select("label", "rep", "n", chunks.alias("chunk"))
    first = F.col("chunk") * DRAWS
    each = F.explode(F.sequence(first, F.least(first + DRAWS, F.col("n")) - 1)).alias("j")
    named = cut.select("label", "rep", each).withColumn("draw", F.concat_ws("/", "label", "j"))
    size = F.when(F.col("label") == 1, sizes[1]).otherwise(sizes[0]).cast("bigint")
    indexed = with_index(with_digest(named, "draw"), "idx", F.col("rep"), seed, size).select("label", "rep", "idx")
    return indexed.join(dense_index(pool, ["label"], "key").select("label", "idx", "key"), ["label", "idx"]).select("key", "rep")


def deltas(values: DataFrame, first: str, rivals: Sequence[str]) -> DataFrame:
    """Differences between one tool's areas and each rival's on the same resamples, with intervals.

    ``values`` comes from ``replicate_areas`` over tools that score the same keys.
    """
    values = durable(values)  # read twice
    own = values.filter(F.col("tool") == first).select("rep", F.col("auroc").alias("_a"), F.col("auprc").alias("_p"))
    other = values.filter(F.col("tool").isin(*rivals)).join(own, "rep")
    both = other.select(
        F.lit(first).alias("tool_a"),
        F.col("tool").alias("tool_b"),
        "rep",
        (F.col("_a") - F.col("auroc")).alias("delta_auroc"),
        (F.col("_p") - F.col("auprc")).alias("delta_auprc"),
    )
    return _interval(both, ["tool_a", "tool_b"], ["delta_auroc", "delta_auprc"])


def paired_bootstrap_delta(
    scored: DataFrame,
    tool_a: str,
    tool_b: str | Sequence[str],
    reps: int = BOOTSTRAP_REPS,
    seed: int = BOOTSTRAP_SEED,
) -> DataFrame:
    """Difference of AUROC and AUPRC between a tool and its rivals on the same resamples.

    Only keys that all of these tools score take part; after ``align_universe`` that is every key.
    """
    rivals = [tool_b] if isinstance(tool_b, str) else list(tool_b)
    tools = [tool_a, *rivals]
    wide = scored.filter(F.col("tool").isin(*tools)).groupBy("key").agg(
        F.max("label").alias("label"),
        *[F.max(F.when(F.col("tool") == tool, F.col("prob"))).alias(f"_{k}") for k, tool in enumerate(tools)],
    )
    sides = F.array(*[F.struct(F.lit(tool).alias("tool"), F.col(f"_{k}").alias("prob")) for k, tool in enumerate(tools)])
    common = wide.dropna(subset=[f"_{k}" for k in range(len(tools))]).select("key", "label", F.inline(sides))
    return deltas(replicate_areas(common, ["tool"], reps, seed), tool_a, rivals)

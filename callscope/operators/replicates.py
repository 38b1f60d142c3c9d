"""Areas of every bootstrap replicate without a row per key and replicate.

A replicate's weights follow from (key, replicate) alone, so they can be made wherever the key's row
is. Rows are dealt once to parts of counted size along the score axis, highest score first; a score
shared by many rows simply runs through several parts, cut by the hash of the key. A part is
summed up in one row of vectors, a number per replicate: its totals and the totals of its last
score. These summaries are scanned by windows per replicate, which gives what lies before each
part, and how much of its first score other parts hold. With that, a second pass takes each part down
from the right start and closes every score exactly once. Between the passes there are only rows per
(part, replicate), however many keys there are, and no task holds more rows than a part has,
whatever the scores look like.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.hashing import poisson_bounds, poisson_weights, with_digest
from callscope.session import durable, ship

#: Rows of a part, as counted rows are dealt; rows handled at a time, few enough that their weights stay in a
#: processor's cache and that products of their sums are exact in 32-bit floats.
PART_ROWS = 16_384
BLOCK = 64
#: Beyond this number of parts they grow to ``PART_GROWTH`` times the rows, so that summaries stay few.
MANY_PARTS = 512
PART_GROWTH = 8
#: Terms of the curve are rounded to this share of one and added up as whole numbers, so that their sum does not
#: depend on where parts begin.
CURVE_UNIT = 2.0**-32

SUMS = "g string, part int, head double, tail double, pos array<bigint>, neg array<bigint>, tail_pos array<bigint>, tail_neg array<bigint>"
AREAS = "g string, part int, pairs array<bigint>, curve array<bigint>"


@dataclass(frozen=True)
class Draws:
    """How rows weigh: Poisson by the bounds of their label, but for replicates that are ``off``,
    and once more for every replicate in their list of extra draws."""

    reps: int
    seed: int
    bounds: tuple[tuple[int, ...], tuple[int, ...]]
    off: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def weights(self, label: np.ndarray, h: np.ndarray, l: np.ndarray, extra: list[list[int] | None] | None) -> np.ndarray:
        """A row of counts per row: the data itself, then the replicates."""
        again = [k for k, x in enumerate(extra) if x is not None] if extra else []
        if not again and not any(self.off) and self.bounds[0] == self.bounds[1]:
            return poisson_weights(h, l, self.reps, self.seed, self.bounds[0])
        out = np.zeros((len(label), self.reps + 1), np.int32)
        plain = np.ones(len(label), bool)
        plain[again] = False
        for value in (0, 1):
            own = plain & (label == value)
            if own.any():
                out[own] = poisson_weights(h[own], l[own], self.reps, self.seed, self.bounds[value])
                if self.off[value]:
                    out[np.ix_(own, [rep + 1 for rep in self.off[value]])] = 0
        if again:
            lists = [extra[k] for k in again]
            drawn = np.array([rep for x in lists for rep in x], np.int64)
            np.add.at(out, (np.repeat(again, [len(x) for x in lists]), drawn + 1), 1)
        return out


def poisson_draws(reps: int, seed: int) -> Draws:
    """Every row weighs Poisson(1) per replicate."""
    return Draws(reps, seed, (poisson_bounds(1.0),) * 2)


def _arrow(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(),
             "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in spec.split(","))])


def _batch(spec: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _arrow(spec)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Sums:
    """Totals of a part, and of the score that is open at its end."""

    def __init__(self, lead: tuple, reps: int):
        self.pos, self.neg, self.tail_pos, self.tail_neg = (np.zeros(reps + 1, np.int64) for _ in range(4))
        self.head = self.tail = None

    def rows(self, prob: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        if self.head is None:
            self.head = float(prob[0])
        if self.tail != prob[-1]:
            self.tail = float(prob[-1])
            self.tail_pos[:], self.tail_neg[:] = 0, 0
        positive, last = label == 1, prob == prob[-1]
        chosen = np.stack([positive, ~positive, positive & last, ~positive & last]).astype(np.float32)
        for total, own in zip((self.pos, self.neg, self.tail_pos, self.tail_neg), chosen @ weight.astype(np.float32)):
            total += own.astype(np.int64)

    def result(self) -> tuple:
        return self.head, self.tail, self.pos, self.neg, self.tail_pos, self.tail_neg


class _Areas:
    """Running totals down a part, from the totals before its first score.

    A run of equal scores stays open until the next score; the last one is left to the part that
    ends it. Runs that begin and end inside a block are closed together: their running totals are products
    of a triangle of ones with the block's weights.
    """

    def __init__(self, lead: tuple, reps: int):
        head, self.goes_on, tp, fp, pos, neg = lead
        head = float(head)
        self.tp, self.fp = np.array(tp, np.int64), np.array(fp, np.int64)
        self.score, self.pos, self.neg = head, np.array(pos, np.int64), np.array(neg, np.int64)
        self.pairs, self.curve = np.zeros(reps + 1, np.int64), np.zeros(reps + 1, np.int64)

    def _curve(self, tp: np.ndarray, both: np.ndarray, pos: np.ndarray, all_: np.ndarray) -> None:
        """Add the terms of runs: totals behind them, and what they hold themselves; one row each."""
        own = tp / np.maximum(both, 1.0)
        tp -= pos
        both -= all_
        first = both == 0 if both[0].min() == 0 else None
        np.maximum(both, 1.0, out=both)
        tp /= both
        if first is not None:
            tp[first] = 1.0
        own += tp
        own *= pos
        own *= 0.5 / CURVE_UNIT
        self.curve += np.rint(own, out=own).sum(axis=0).astype(np.int64)

    def _close(self) -> None:
        """The open run ends."""
        pos, neg = self.pos, self.neg
        self.pairs += neg * (2 * self.tp + pos)
        self.tp = self.tp + pos
        self.fp = self.fp + neg
        if pos.any():
            as_row = lambda x: x.astype(np.float64)[None, :]
            self._curve(as_row(self.tp), as_row(self.tp + self.fp), as_row(pos), as_row(pos + neg))

    def _inside(self, run: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> None:
        """Whole runs of a block; ``run`` numbers them from 0 on."""
        number = np.arange(run[-1] + 1)
        positives = np.flatnonzero(positive)
        w_pos, run_pos = weight[positives], run[positives]
        held = np.unique(run_pos)
        if len(held):
            to = (run_pos[None, :] <= held[:, None]).astype(np.float32)
            tp = to @ w_pos + self.tp.astype(np.float64)
            both = (run[None, :] <= held[:, None]).astype(np.float32) @ weight + (self.tp + self.fp).astype(np.float64)
            if len(number) == len(run):  # no ties
                self._curve(tp, both, w_pos, w_pos)
            else:
                pos = (run_pos[None, :] == held[:, None]).astype(np.float32) @ w_pos
                self._curve(tp, both, pos, (run[None, :] == held[:, None]).astype(np.float32) @ weight)
        w_neg, run_neg = weight[~positive], run[~positive]
        neg = w_neg.sum(axis=0).astype(np.int64)
        self.pairs += 2 * self.tp * neg
        if len(held) and len(run_neg):
            ahead = (run_pos[None, :] < run_neg[:, None]).astype(np.float32)
            ahead += run_pos[None, :] <= run_neg[:, None]
            ahead = ahead @ w_pos
            ahead *= w_neg
            self.pairs += ahead.sum(axis=0).astype(np.int64)
            self.tp = self.tp + w_pos.sum(axis=0).astype(np.int64)
        elif len(held):
            self.tp = self.tp + w_pos.sum(axis=0).astype(np.int64)
        self.fp = self.fp + neg

    def rows(self, prob: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        weight, positive = weight.astype(np.float32), label == 1
        fresh = prob[1:] != prob[:-1]
        starts = np.flatnonzero(fresh) + 1
        first, last = (starts[0], starts[-1]) if len(starts) else (len(prob), 0)

        def sums(a: int, b: int) -> np.ndarray:
            chosen = np.stack([positive[a:b], ~positive[a:b]]).astype(np.float32)
            return (chosen @ weight[a:b]).astype(np.int64)

        if self.score != prob[0]:
            self._close()
            self.score, self.pos, self.neg = prob[0], 0, 0
        self.pos, self.neg = (x + y for x, y in zip((self.pos, self.neg), sums(0, first)))
        if not len(starts):
            return
        self._close()
        if last > first:
            self._inside(np.cumsum(np.concatenate([[0], fresh[first : last - 1]])), positive[first:last], weight[first:last])
        self.score, (self.pos, self.neg) = prob[-1], sums(last, len(prob))

    def result(self) -> tuple:
        if not self.goes_on:
            self._close()
        return self.pairs, self.curve


def _down(rows: DataFrame, kind: Callable, spec: str, draws: Draws) -> DataFrame:
    """One row per (g, part) from its rows in order; ``lead`` holds what is known before the first."""
    block = BLOCK * max(1, min(4, 1000 // max(1, draws.reps)))  # few replicates leave room for more rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column(0).dictionary_encode()
            code, part = named.indices.to_numpy(), batch.column(1).to_numpy()
            prob, label, h, l = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            label, h, l = (np.nan_to_num(x).astype(np.int64) for x in (label, h, l))
            lead, extra = batch.column(6), batch.column(7)
            again = None
            if extra.null_count < batch.num_rows:  # all lists of a batch are read at once
                again = [None] * batch.num_rows
                held = json.loads(f"[{','.join(extra.drop_null().to_pylist())}]")
                for k, drawn in zip(np.flatnonzero(extra.is_valid()).tolist(), held, strict=True):
                    again[k] = drawn
            fresh = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1
            for at, stop in zip([0, *fresh.tolist()], [*fresh.tolist(), batch.num_rows]):
                key = named.dictionary[int(code[at])].as_py(), int(part[at])
                if key != now:
                    if now is not None:
                        yield _batch(spec, [(*now, *own.result())])
                    known = lead[at].as_py()
                    now, own = key, kind(tuple(json.loads(known)[x] for x in KNOWN) if known else (), draws.reps)
                    at += known is not None
                for a in range(at, stop, block):
                    b = min(a + block, stop)
                    own.rows(prob[a:b], label[a:b], draws.weights(label[a:b], h[a:b], l[a:b], again and again[a:b]))
        if now is not None:
            yield _batch(spec, [(*now, *own.result())])

    # Nested columns cost many times the rest on their way to Python even where they are null; as text they do not.
    as_text = [F.to_json(name).alias(name) for name in ("lead", "extra")]
    return rows.select("g", "part", "prob", "label", "h", "l", *as_text).mapInArrow(run, spec)


KNOWN = ("head", "goes_on", "tp", "fp", "pos", "neg")
LEAD = "struct<head: double, goes_on: boolean, tp: array<bigint>, fp: array<bigint>, pos: array<bigint>, neg: array<bigint>>"


def _scanned(sums: DataFrame) -> DataFrame:
    """Per (g, part, rep): totals before the part's first score, that score's totals in earlier parts,
    whether the last score goes on, and the totals of all."""
    zipped = F.arrays_zip("pos", "neg", "tail_pos", "tail_neg")
    long = sums.select("g", "part", "head", "tail", F.posexplode(zipped).alias("rep", "z")).select(
        "g", "part", "head", "tail", "rep", "z.*"
    )
    scope = Window.partitionBy("g", "rep").orderBy("part")
    before = scope.rowsBetween(Window.unboundedPreceding, -1)
    everything = scope.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Parts that end in one score follow each other, so what they hold of it is a running total.
    same = Window.partitionBy("g", "rep", "tail").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    held = long.select(
        "*",
        *[F.sum(f"tail_{x}").over(same).alias(f"held_{x}") for x in ("pos", "neg")],
    )
    first_goes_back = F.lag("tail").over(scope) == F.col("head")
    return held.select(
        "g",
        "part",
        "rep",
        "head",
        F.coalesce(F.lead("head").over(scope) == F.col("tail"), F.lit(False)).alias("goes_on"),
        *[F.coalesce(F.sum(x).over(before), zero).alias(f"before_{x}") for x in ("pos", "neg")],
        *[F.when(first_goes_back, F.lag(f"held_{x}").over(scope)).otherwise(zero).alias(x) for x in ("pos", "neg")],
        F.sum("pos").over(everything).alias("p"),
        F.sum("neg").over(everything).alias("n"),
    )


def weighted_areas(rows: DataFrame, draws: Draws) -> DataFrame:
    """``g, rep, auroc, auprc`` of every replicate with both classes; replicate -1 is the data.

    ``rows``: g, prob, label, the digest's halves h and l, and extra: null, or the replicates for which
    a row counts once more (it then has no other weight).
    """
    kept = durable(rows.select("g", (F.col("prob") + F.lit(0.0)).alias("prob"), "label", "h", "l", "extra"))
    many = kept.count()
    parts = max(1, min(-(-many // PART_ROWS), max(MANY_PARTS, -(-many // (PART_GROWTH * PART_ROWS)))))
    order = [F.col("g"), F.col("prob").desc(), F.col("h"), F.col("l")]
    ranged = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Stored, since the bounds of parts come from a sample and both passes need the same ones.
    dealt = durable(ranged.withColumn("part", F.spark_partition_id()))
    no_lead = dealt.withColumn("lead", F.lit(None).cast(LEAD))
    scanned = durable(_scanned(_down(no_lead, _Sums, SUMS, draws)))
    by_rep = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("rep", name))), lambda x: x[name])
    leads = scanned.groupBy("g", "part").agg(
        F.first("head").alias("head"),
        F.first("goes_on").alias("goes_on"),
        *[by_rep(name).alias(name) for name in ("before_pos", "before_neg", "pos", "neg")],
    )
    less = lambda all_, own: F.zip_with(all_, own, lambda a, b: a - b)
    lead = F.struct("head", "goes_on", less("before_pos", "pos"), less("before_neg", "neg"), "pos", "neg").cast(LEAD)
    heads = leads.select("g", "part", lead.alias("lead"))
    stacked = heads.unionByName(dealt, allowMissingColumns=True).repartitionById(parts, F.col("part"))
    stacked = stacked.sortWithinPartitions("g", "part", F.col("lead").isNull(), F.desc("prob"))
    inside = _down(stacked, _Areas, AREAS, draws)
    sums = (
        inside.select("g", F.posexplode(F.arrays_zip("pairs", "curve")).alias("rep", "z"))
        .groupBy("g", "rep")
        .agg(F.sum("z.pairs").alias("pairs"), F.sum("z.curve").alias("curve"))
    )
    totals = scanned.groupBy("g", "rep").agg(F.first("p").alias("p"), F.first("n").alias("n"))
    values = totals.join(sums, ["g", "rep"]).filter((F.col("p") > 0) & (F.col("n") > 0))
    return values.select(
        "g",
        (F.col("rep") - 1).alias("rep"),
        (F.col("pairs") / (2.0 * F.col("p") * F.col("n"))).alias("auroc"),
        (F.col("curve") * F.lit(CURVE_UNIT) / F.col("p")).alias("auprc"),
    )


def scored_rows(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Labelled rows with a score, in the form of ``weighted_areas``; ``g`` holds the group."""
    named = scored.filter(F.col("label").isin(0, 1) & F.col("prob").isNotNull() & ~F.isnan("prob")).select(
        F.to_json(F.struct(*group)).alias("g"), "key", F.col("prob").cast("double").alias("prob"), F.col("label").cast("int").alias("label")
    )
    return with_digest(named, "key", ("h", "l")).withColumn("extra", F.lit(None).cast("array<int>"))


def named_groups(values: DataFrame, scored: DataFrame, group: Sequence[str]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name in group)
    return values.select(F.from_json("g", fields).alias("_g"), *[c for c in values.columns if c != "g"]).select(
        "_g.*", *[c for c in values.columns if c != "g"]
    )


def weight_sums(keys: DataFrame, draws: Draws) -> DataFrame:
    """``label, rep, total``: the weights of all rows of ``keys`` (label, h, l) per replicate, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, draws.reps), np.int64)
        for batch in batches:
            label, h, l = (x.to_numpy() for x in batch.columns)
            for value in (0, 1):
                own = np.flatnonzero(label == value)
                for at in range(0, len(own), BLOCK):
                    k = own[at : at + BLOCK]
                    sums[value] += poisson_weights(h[k], l[k], draws.reps, draws.seed, draws.bounds[value]).sum(axis=0, dtype=np.int64)[1:]
        labels, reps = np.repeat([0, 1], draws.reps).astype(np.int32), np.tile(np.arange(draws.reps, dtype=np.int32), 2)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (labels, reps, sums.ravel())], ["label", "rep", "total"])

    rows = keys.select("label", "h", "l").mapInArrow(run, "label int, rep int, total bigint")
    return rows.groupBy("label", "rep").agg(F.sum("total").alias("total"))


def replicate_areas(scored: DataFrame, group: Sequence[str], reps: int, seed: int) -> DataFrame:
    """``group, rep, auroc, auprc`` of every replicate that has both classes; replicate -1 is the data.

    Row weights are Poisson(1) by (key, replicate) and shared by all tools. ``prob`` must not be NULL.
    """
    ship(scored.sparkSession)
    group = list(group)
    return named_groups(weighted_areas(scored_rows(scored, group), poisson_draws(reps, seed)), scored, group)

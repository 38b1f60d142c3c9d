"""Logistic regression fitted epoch by epoch, with held-out metrics, early stop and resume.

One step is one Spark job: tasks add up gradients over their rows, their sums meet per coordinate
in a shuffle with map-side sums, and the driver sees one number per feature. After each epoch the held-out
side is scored and ranked by the exact curve. What a fit is made of - coefficients, optimiser moments,
steps, history, the best epoch - is one small state, written after each epoch under its number;
a stopped fit goes on from the newest one and ends where an uninterrupted one would.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.hashing import with_digest, with_draw
from callscope.operators import curves
from callscope.operators.resample import hash_split
from callscope.session import durable, ship

VERSION = 1
METRICS = ("auroc", "average_precision")
#: Digits kept of probabilities, so that equal rows have equal scores whatever batch they come in.
SCORE_DIGITS = 12
HISTORY = "epoch int, train_loss double, valid_loss double, auroc double, average_precision double, best boolean"


@dataclass(frozen=True)
class Settings:
    """``batches`` optimiser steps make an epoch; rows are dealt to them by the hash of their key."""

    epochs: int = 10
    patience: int = 3
    metric: str = "auroc"
    learning_rate: float = 0.1
    batches: int = 1
    l2: float = 0.0
    decay: tuple[float, float] = (0.9, 0.999)
    train_share: float = 0.8
    seed: int = 42

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")

    def same_fit(self, other: Settings) -> bool:
        """Whether two settings differ in the length of the fit only."""
        free = {"epochs": 0, "patience": 0}
        return dataclasses.replace(self, **free) == dataclasses.replace(other, **free)


@dataclass
class State:
    """Everything a fit needs to go on; lists have one number per feature, coefficients the intercept last."""

    settings: Settings
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    first_moment: list[float]
    second_moment: list[float]
    steps: int = 0
    epoch: int = 0
    best_epoch: int = 0
    best_value: float | None = None
    best_coefficients: list[float] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    version: int = VERSION

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> State:
        raw = json.loads(text)
        if raw["version"] != VERSION:
            raise ValueError(f"training state of version {raw['version']}, not {VERSION}")
        raw["settings"] = Settings(**raw["settings"] | {"decay": tuple(raw["settings"]["decay"])})
        return cls(**raw)

    def stopped(self, settings: Settings) -> bool:
        return self.epoch >= settings.epochs or self.epoch - self.best_epoch >= settings.patience


def save_state(spark: SparkSession, state: State, folder: str) -> None:
    """Write a state below ``folder`` under its epoch; earlier ones stay."""
    row = [(state.version, state.to_json())]
    rows = spark.createDataFrame(row, "version int, state string").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={state.epoch}")


def load_state(spark: SparkSession, folder: str, epoch: int | None = None) -> State | None:
    """The state after ``epoch``, or the newest one; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    # A folder without the writer's mark is from a run that died while it wrote.
    names = [x.getPath() for x in files.listStatus(path) if files.exists(hadoop.Path(x.getPath(), "_SUCCESS"))]
    epochs = {int(x.getName().split("=")[1]): x.toString() for x in names if x.getName().startswith("epoch=")}
    chosen = epochs.get(max(epochs) if epoch is None else epoch) if epochs else None
    return State.from_json(spark.read.parquet(chosen).first()["state"]) if chosen else None


def _numbers(batch: pa.RecordBatch, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features as a matrix, labels, weights."""
    column = batch.column(0)
    lists = column.flatten().to_numpy(zero_copy_only=False)
    matrix = lists.reshape(batch.num_rows, -1 if width is None else width)
    return matrix, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, parts) -> dict[int, float]:
    """Coordinate sums of what ``parts`` makes of the batches of a task: one number each on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = parts(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    sums = rows.select("features", "y", "w").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    return {r["i"]: r["x"] for r in sums.collect()}


def _probabilities(matrix: np.ndarray, state: State, coefficients: list[float]) -> np.ndarray:
    scaled = (matrix - np.array(state.mean)) / np.array(state.scale)
    z = scaled @ np.array(coefficients[:-1]) + coefficients[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _started(train: DataFrame, settings: Settings) -> State:
    def moments(batch):
        x, _, w = _numbers(batch, None)
        return np.concatenate([[w.sum()], w @ x, w @ (x * x)])

    sums = _summed(train, moments)
    if not sums:
        raise ValueError("no rows to train on")
    d = (len(sums) - 1) // 2
    mean = [sums[1 + i] / sums[0] for i in range(d)]
    spread = [max(sums[1 + d + i] / sums[0] - mean[i] ** 2, 0.0) ** 0.5 for i in range(d)]
    zeros = [0.0] * (d + 1)
    return State(settings, mean, [x or 1.0 for x in spread], zeros, list(zeros), list(zeros))


def _step(state: State, batch_rows: DataFrame) -> tuple[float, float]:
    """One optimiser step; returns the weighted loss before it and the weight."""
    d = len(state.mean)
    coefficients = list(state.coefficients)

    def gradient(batch):
        x, y, w = _numbers(batch, d)
        p = _probabilities(x, state, coefficients)
        off = w * (p - y)
        scaled = (x - np.array(state.mean)) / np.array(state.scale)
        return np.concatenate([off @ scaled, [off.sum(), (w * _losses(p, y)).sum(), w.sum()]])

    sums = _summed(batch_rows, gradient)
    if not sums or sums[d + 2] == 0:
        return 0.0, 0.0
    g = np.array([sums[i] for i in range(d + 1)]) / sums[d + 2]
    g[:d] += state.settings.l2 * np.array(coefficients[:d])
    state.steps += 1
    a, b = state.settings.decay
    m = a * np.array(state.first_moment) + (1 - a) * g
    v = b * np.array(state.second_moment) + (1 - b) * g * g
    ahead = state.settings.learning_rate * (m / (1 - a**state.steps)) / (np.sqrt(v / (1 - b**state.steps)) + 1e-8)
    state.first_moment, state.second_moment = m.tolist(), v.tolist()
    state.coefficients = (np.array(coefficients) - ahead).tolist()
    return sums[d + 1], sums[d + 2]


def _scored(rows: DataFrame, state: State, coefficients: list[float], keep: list[str]) -> DataFrame:
    """``keep`` and prob of rows that have features, y and w."""
    d = len(state.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _ = _numbers(batch, d)
            p = np.round(_probabilities(x, state, coefficients), SCORE_DIGITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(p)], [*keep, "prob"])

    schema = rows.select(*keep).schema.add("prob", "double")
    return rows.select("features", "y", "w", *keep).mapInArrow(run, schema)


def _held_out(state: State, held: DataFrame) -> dict[str, float | None]:
    scored = durable(_scored(held.withColumn("label", F.col("y").cast("int")), state, state.coefficients, ["label", "w"]))
    areas = curves.scored_curve(scored, []).agg(
        curves.auroc().alias("auroc"), curves.average_precision().alias("average_precision")
    ).first()
    p = F.least(F.greatest("prob", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    mean = scored.agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("x")).first()["x"]
    return {"valid_loss": mean, "auroc": areas["auroc"], "average_precision": areas["average_precision"]}


def prepared(rows: DataFrame, settings: Settings, features: str, label: str, key: str, weight: str | None) -> DataFrame:
    """features, y, w, split, batch: rows without a label are left out, nulls in features count as 0."""
    filled = F.transform(F.col(features).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    chosen = rows.filter(F.col(label).isin(0, 1)).select(
        F.col(key).cast("string").alias("key"),
        filled.alias("features"),
        F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    drawn = with_draw(with_digest(hash_split(chosen, "key", settings.train_share, settings.seed)), "_b", 1, settings.seed)
    return drawn.select("features", "y", "w", "split", (F.col("_b") % settings.batches).cast("int").alias("batch"))


def fit(
    rows: DataFrame,
    settings: Settings = Settings(),
    features: str = "features",
    label: str = "label",
    key: str = "key",
    weight: str | None = None,
    folder: str | None = None,
    start: State | None = None,
) -> State:
    """Fit until ``settings.epochs``, or until the metric has not risen for ``patience`` epochs.

    All rows of a key are on one side. With ``folder`` the state is written after each epoch, and a
    fit that finds one there goes on from it; ``start`` gives a state to go on from (warm start). Going on
    with other settings than the length of the fit is an error.
    """
    spark = rows.sparkSession
    ship(spark)
    data = durable(prepared(rows, settings, features, label, key, weight))
    train, held = data.filter("split = 'train'"), data.filter("split = 'validation'")
    state = start or (load_state(spark, folder) if folder else None) or _started(train, settings)
    if not state.settings.same_fit(settings):
        raise ValueError("the stored fit has other settings")
    state = dataclasses.replace(state, settings=settings, history=list(state.history))
    while not state.stopped(settings):
        sums = [_step(state, train.filter(F.col("batch") == k)) for k in range(settings.batches)]
        losses, total = map(sum, zip(*sums))
        found = _held_out(state, held)
        state.epoch += 1
        value = found[settings.metric]
        if value is not None and (state.best_value is None or value > state.best_value):
            state.best_epoch, state.best_value, state.best_coefficients = state.epoch, value, list(state.coefficients)
        state.history.append({"epoch": state.epoch, "train_loss": losses / total if total else None} | found)
        if folder:
            save_state(spark, state, folder)
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """One row per epoch: losses, held-out areas, and whether it is the epoch that is kept."""
    rows = [(*[h[name] for name in ("epoch", "train_loss", "valid_loss", *METRICS)], h["epoch"] == state.best_epoch) for h in state.history]
    return spark.createDataFrame(rows, HISTORY)


def score(rows: DataFrame, state: State, features: str = "features", threshold: float = 0.5) -> DataFrame:
    """``prob`` and ``pred`` of every row by the coefficients of the best epoch; other columns stay, features go."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != features]
    filled = F.transform(F.col(features).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    inner = rows.select(filled.alias("features"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.struct(*keep).alias("row"))
    coefficients = state.best_coefficients or state.coefficients
    scored = _scored(inner, state, coefficients, ["row"])
    return scored.select("row.*", "prob", (F.col("prob") >= threshold).cast("int").alias("pred"))

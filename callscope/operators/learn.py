"""Train and apply a binary classifier on evidence and sequence, as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplitModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import curves
from callscope.operators.metrics import class_weights
from callscope.operators.resample import hash_split


def vectorise(rows: DataFrame, arrays: Sequence[str], output: str = "features_raw") -> DataFrame:
    """One ML vector from numeric arrays; nested arrays (one-hot sequence) are flattened."""
    parts = []
    nested = {f.name: f.dataType.simpleString().startswith("array<array<") for f in rows.schema}
    for name in arrays:
        column = F.flatten(name) if nested[name] else F.col(name)
        parts.append(column.cast("array<double>"))
    return rows.withColumn(output, array_to_vector(F.concat(*parts) if len(parts) > 1 else parts[0]))


def with_class_weight(
    rows: DataFrame, pos_weight: float | None = None, label: str = "label", weight: str = "weight"
) -> DataFrame:
    """Row weights: a fixed factor for positives, or inverse class frequency if none is given."""
    if pos_weight is None:
        return class_weights(rows, label, weight)
    return rows.withColumn(weight, F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0))


def classifier(kind: str = "logistic", label: str = "label", weight: str | None = "weight", **params) -> Estimator:
    """Scale, then logistic regression or gradient-boosted trees."""
    makers = {"logistic": LogisticRegression, "gbt": GBTClassifier}
    if kind not in makers:
        raise ValueError(f"kind must be one of {sorted(makers)}")
    model = makers[kind](featuresCol="features", labelCol=label, **params)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=["features_raw"], outputCol="features_in"),
            StandardScaler(inputCol="features_in", outputCol="features", withMean=False, withStd=True),
            model,
        ]
    )


class AreaEvaluator(Evaluator, HasLabelCol):
    """Exact AUROC or average precision as a model-selection metric; larger is better."""

    def __init__(self, metric: str = "auroc", label: str = "label"):
        super().__init__()
        if metric not in ("auroc", "average_precision"):
            raise ValueError("metric must be auroc or average_precision")
        self.metric = metric
        self._set(labelCol=label)

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(
            F.col(self.getLabelCol()).cast("int").alias("label"),
            vector_to_array("probability")[1].alias("prob"),
        )
        points = curves.scored_curve(scored, [])
        value = points.agg(
            curves.auroc().alias("auroc"), curves.average_precision().alias("average_precision")
        ).first()[self.metric]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


def select_model(
    rows: DataFrame,
    estimator: Estimator,
    grid: dict[str, Sequence] | None = None,
    metric: str = "auroc",
    train_share: float = 0.8,
    seed: int = 42,
    parallelism: int = 1,
    key: str = "key",
) -> TrainValidationSplitModel:
    """Fit every setting of the last stage's parameters and keep the best on the validation share.

    ``hash_split`` splits by ``key``, so all rows of a key are on one side in any layout. The best
    setting is fitted again on all rows.
    """
    builder = ParamGridBuilder()
    last = estimator.getStages()[-1]
    for name, values in (grid or {}).items():
        builder = builder.addGrid(last.getParam(name), list(values))
    settings = builder.build()
    split = hash_split(rows, key, train_share, seed)
    train, held = (split.filter(F.col("split") == side).drop("split") for side in ("train", "validation"))
    evaluator = AreaEvaluator(metric, last.getLabelCol())
    with ThreadPool(max(1, parallelism)) as pool:
        values = pool.map(lambda setting: evaluator.evaluate(estimator.fit(train, setting).transform(held)), settings)
    # A setting without a value (a side lost a class) never wins over one with a value.
    best = max(range(len(settings)), key=lambda k: (values[k] == values[k], values[k]))
    return TrainValidationSplitModel(estimator.fit(rows, settings[best]), values)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``prob`` and ``pred``; the model's working columns are dropped."""
    keep = [c for c in rows.columns if c != "features_raw"]
    scored = model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("prob"))
    return scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def score_with(
    rows: DataFrame, load: Callable[[], Callable], inputs: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Score with a model of your own, in Arrow batches.

    ``load`` runs once per task and returns a function from a pandas frame of ``inputs`` to
    probabilities. This is the one place where rows pass through Python.
    """
    schema = rows.select(*keep).schema.add("prob", "double")

    def run(batches: Iterator) -> Iterator:
        predict = load()
        for batch in batches:
            result = batch[list(keep)].copy()
            result["prob"] = predict(batch[list(inputs)])
            yield result

    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)

import pytest
from pyspark.sql import functions as F

from callscope.operators import curves, learn, metrics


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        F.col("id").cast("string").alias("key"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.array((F.col("id") % 4 == 0).cast("double") + F.rand(1) * 0.8, F.rand(2)).alias("qc"),
        F.array(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(1))).alias("seq"),
    ).cache()


def test_train_score_save(spark, rows, tmp_path):
    vectors = learn.with_class_weight(learn.vectorise(rows, ["qc", "seq"]))
    assert vectors.first()["features_raw"].size == 6
    model = learn.classifier("logistic", maxIter=20).fit(vectors)
    scored = learn.score(model, vectors).withColumn("tool", F.lit("m"))
    assert {"prob", "pred"} <= set(scored.columns)
    assert curves.areas(curves.scored_curve(scored)).first()["auroc"] > 0.9
    learn.save_model(model, str(tmp_path / "model"))
    again = learn.score(learn.load_model(str(tmp_path / "model")), vectors)
    assert again.select(F.sum("prob")).first() == scored.select(F.sum("prob")).first()


def test_weights(rows):
    weights = {r["label"]: r["weight"] for r in metrics.class_weights(rows).select("label", "weight").distinct().collect()}
    assert weights == {0: 1 / 300, 1: 1 / 100}
    fixed = learn.with_class_weight(rows, pos_weight=3.0).select("label", "weight").distinct().collect()
    assert {r["label"]: r["weight"] for r in fixed} == {0: 1.0, 1: 3.0}


def test_select_model(rows):
    vectors = learn.with_class_weight(learn.vectorise(rows, ["qc"]), 1.0)
    best = learn.select_model(vectors, learn.classifier("logistic", maxIter=10), {"regParam": [0.01, 100.0]})
    assert len(best.validationMetrics) == 2 and best.validationMetrics[0] > 0.9
    with pytest.raises(ValueError):
        learn.classifier("other")


def test_own_model(rows):
    def load():
        return lambda frame: frame["x"] * 0.5

    flat = rows.select("key", "label", F.col("qc")[0].alias("x"))
    got = learn.score_with(flat, load, ["x"], ["key", "label"])
    assert got.columns == ["key", "label", "prob"]
    joined = got.join(flat.select("key", "x"), "key")
    assert joined.filter(F.abs(F.col("prob") - F.col("x") * 0.5) > 1e-12).count() == 0

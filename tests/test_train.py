import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.functions.hashing import with_digest, with_draw
from callscope.operators import curves, train
from callscope.operators.resample import hash_split


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (x[:, 0] + (x[:, 1] - 5) / 10 + draw.normal(size=900) > 0.4).astype(int)
    data = [(f"k{k}", [float(v) for v in own], int(label), 1.0 + k % 2) for k, (own, label) in enumerate(zip(x, y))]
    data.append(("none", [0.0, 0.0, 0.0], None, 1.0))
    return spark.createDataFrame(data, "key string, features array<double>, label int, weight double").cache()


def plain_fit(rows, settings, weight):
    """The same fit in one place; a list of (train loss, coefficients) per epoch."""
    drawn = with_draw(with_digest(hash_split(rows.filter("label is not null"), "key", settings.train_share, settings.seed)), "_b", 1, settings.seed)
    own = drawn.filter("split = 'train'").collect()
    x, y = np.array([r["features"] for r in own]), np.array([r["label"] for r in own])
    w, batch = np.array([r[weight] if weight else 1.0 for r in own]), np.array([r["_b"] % settings.batches for r in own])
    mean = (w @ x) / w.sum()
    x = (x - mean) / np.sqrt((w @ (x * x)) / w.sum() - mean**2)
    x = np.hstack([x, np.ones((len(x), 1))])
    c, m, v, out, t = np.zeros(4), np.zeros(4), np.zeros(4), [], 0
    for _ in range(settings.epochs):
        losses = 0
        for k in range(settings.batches):
            b = batch == k
            p = 1 / (1 + np.exp(-x[b] @ c))
            losses += -(w[b] * np.where(y[b] == 1, np.log(p), np.log(1 - p))).sum()
            g = (w[b] * (p - y[b])) @ x[b] / w[b].sum() + settings.l2 * np.append(c[:3], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            c = c - settings.learning_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        out.append((losses / w.sum(), c.copy()))
    return out


@pytest.mark.parametrize("batches,weight", [(1, None), (3, "weight")])
def test_against_plain_fit(rows, batches, weight):
    settings = train.Settings(epochs=4, patience=9, batches=batches, l2=0.01)
    state = train.fit(rows, settings, weight=weight)
    want = plain_fit(rows, settings, weight)
    assert [h["train_loss"] for h in state.history] == pytest.approx([loss for loss, _ in want])
    assert state.coefficients == pytest.approx(want[-1][1])
    assert state.steps == 4 * batches


def test_epoch_metrics_and_best_epoch(spark, rows):
    state = train.fit(rows, train.Settings(epochs=5, patience=9))
    table = train.history(spark, state).orderBy("epoch").collect()
    assert [r["epoch"] for r in table] == [1, 2, 3, 4, 5]
    best = max(table, key=lambda r: r["auroc"])
    assert state.best_value == best["auroc"] and [r["best"] for r in table].count(True) == 1
    held = hash_split(rows.filter("label is not null")).filter("split = 'validation'")
    scored = train.score(held, state)
    assert {"key", "label", "prob", "pred", "split"} == set(scored.columns) - {"weight"}
    area = curves.scored_curve(scored, []).agg(curves.auroc().alias("a"), curves.average_precision().alias("p")).first()
    assert area["a"] == pytest.approx(state.best_value) and area["a"] > 0.75
    assert area["p"] == pytest.approx(next(r["average_precision"] for r in table if r["best"]))


def test_patience_stops_and_best_epoch_is_kept(rows):
    """A step far too large makes the first epoch the best one."""
    noise = rows.withColumn("label", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int"))
    state = train.fit(noise, train.Settings(epochs=50, patience=2, learning_rate=5.0))
    assert state.epoch == state.best_epoch + 2 < 50
    assert len(state.history) == state.epoch


def test_stop_and_resume_equal_one_run(spark, rows, tmp_path):
    whole = train.fit(rows, train.Settings(epochs=5, patience=9, batches=2))
    folder = str(tmp_path / "fit")
    train.fit(rows, train.Settings(epochs=2, patience=9, batches=2), folder=folder)
    assert train.load_state(spark, folder).epoch == 2
    again = train.fit(rows, train.Settings(epochs=5, patience=9, batches=2), folder=folder)
    assert again.epoch == 5 and again.steps == whole.steps and again.best_epoch == whole.best_epoch
    assert again.coefficients == pytest.approx(whole.coefficients, rel=1e-9)
    assert [h["auroc"] for h in again.history] == pytest.approx([h["auroc"] for h in whole.history])
    assert train.load_state(spark, folder, 3).epoch == 3
    warm = train.fit(rows, train.Settings(epochs=6, patience=9, batches=2), start=train.load_state(spark, folder))
    assert warm.epoch == 6
    with pytest.raises(ValueError, match="other settings"):
        train.fit(rows, train.Settings(epochs=6, batches=2, learning_rate=0.5), folder=folder)
    (tmp_path / "fit" / "epoch=9").mkdir()  # a writer that died
    assert train.load_state(spark, folder).epoch == 5


def test_states_of_other_versions_are_refused(spark, rows, tmp_path):
    state = train.fit(rows, train.Settings(epochs=1))
    state.version = 7
    train.save_state(spark, state, str(tmp_path))
    with pytest.raises(ValueError, match="version 7"):
        train.load_state(spark, str(tmp_path))
    assert train.load_state(spark, str(tmp_path / "none")) is None


def test_odd_rows(spark):
    data = [("a", [1.0, None], 1), ("b", [float("nan"), 2.0], 0), ("c", [0.0, 0.0], None)] + [(f"x{k}", [float(k), 1.0], k % 2) for k in range(40)]
    frame = spark.createDataFrame(data, "key string, features array<double>, label int")
    state = train.fit(frame, train.Settings(epochs=1))
    assert state.epoch == 1 and all(np.isfinite(state.coefficients))
    with pytest.raises(ValueError, match="no rows"):
        train.fit(frame.filter("key = 'c'"))
    with pytest.raises(ValueError, match="metric"):
        train.Settings(metric="loss")

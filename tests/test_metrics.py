import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import curves, distribution, errors, metrics, ordered, overlap


def scored_frame(spark, tools):
    rows = [
        (f"k{i}", int(label), float(prob), tool)
        for tool, (y, s) in tools.items()
        for i, (label, prob) in enumerate(zip(y, s))
    ]
    return spark.createDataFrame(rows, "key string, label int, prob double, tool string")


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    noisy = np.clip(np.round(0.3 * y + 0.7 * rng.random(400), 2), 0, 1)
    return {
        "ties": (y, noisy),
        "fine": (y, np.clip(0.2 * y + 0.8 * rng.random(400), 0, 1)),
        "near_one": (y, 1 - rng.random(400) * 1e-12),
        "constant": (y, np.full(400, 0.3)),
        "perfect": (y, y.astype(float)),
        "presence": (y, ((y == 1) & (rng.random(400) < 0.1)).astype(float)),
    }


@pytest.fixture(scope="module")
def scored(spark, samples):
    return scored_frame(spark, samples).cache()


def test_areas(scored, samples):
    for row in curves.areas(curves.scored_curve(scored)).collect():
        y, s = samples[row["tool"]]
        assert row["auroc"] == pytest.approx(brute.auroc(y, s), abs=1e-12)
        assert row["auprc"] == pytest.approx(brute.auprc(y, s), abs=1e-12)
        assert row["average_precision"] == pytest.approx(brute.average_precision(y, s), abs=1e-12)


def test_library_evaluator_agrees(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    expected = BinaryClassificationEvaluator(
        rawPredictionCol="prob", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(scored.filter("tool = 'fine'").withColumn("label", F.col("label").cast("double")))
    got = curves.areas(curves.scored_curve(scored.filter("tool = 'fine'"))).first()["auroc"]
    assert got == pytest.approx(expected, abs=1e-12)


def test_symmetry_and_monotone_maps(scored):
    base = {r["tool"]: r["auroc"] for r in curves.areas(curves.scored_curve(scored)).collect()}
    turned = scored.withColumn("prob", 1 - F.col("prob"))
    squared = scored.filter("tool <> 'near_one'").withColumn("prob", F.col("prob") * F.col("prob"))
    for row in curves.areas(curves.scored_curve(turned)).collect():
        assert row["auroc"] == pytest.approx(1 - base[row["tool"]], abs=1e-12)
    for row in curves.areas(curves.scored_curve(squared)).collect():
        assert row["auroc"] == base[row["tool"]]


def test_partitions_and_cells_do_not_matter(spark, scored, samples):
    def table(frame):
        counts = curves.score_counts(frame)
        totals = ordered.running_totals(counts, ["tool"], "score", ["pos", "neg"], True)
        return sorted(map(tuple, totals.collect()))

    base = table(scored)
    assert table(scored.repartition(13)) == base
    assert table(scored.coalesce(1)) == base


def test_infinite_scores(spark):
    rows = [("t", f"k{i}", i % 2, s) for i, s in enumerate([float("inf"), 1e305, 2.0, 0.5, -1e305, float("-inf")])]
    frame = spark.createDataFrame(rows, "tool string, key string, label int, prob double")
    assert curves.areas(curves.scored_curve(frame)).first()["auroc"] == pytest.approx(1 / 3)


def test_one_score_holding_most_rows(spark):
    rows = [(f"k{i}", i % 2, 0.0 if i < 900 else i / 1000, "t") for i in range(1000)]
    frame = spark.createDataFrame(rows, "key string, label int, prob double, tool string")
    row = curves.areas(curves.scored_curve(frame)).first()
    y, s = [r[1] for r in rows], [r[2] for r in rows]
    assert row["auroc"] == pytest.approx(brute.auroc(y, s), abs=1e-12)


def _reference_thresholds(y, s):
    """Thresholds read off the array positions of the published procedure."""
    p, r, t = brute.pr(y, s)
    out = {}
    hit = np.where(r >= 0.95)[0]
    out["Recall@0.95"] = t[max(hit.max() - 1, 0)]
    for target in (0.98, 0.90):
        ok = np.where(p >= target)[0]
        out[f"Precision@{target:.2f}"] = t[max(ok[np.argmax(r[ok])] - 1, 0)]
    return out


def test_operating_points(scored, samples):
    points = curves.scored_curve(scored).cache()
    for row in curves.operating_points(points, rule="reference").collect():
        y, s = samples[row["tool"]]
        assert row["threshold"] == _reference_thresholds(y, s)[row["setting"]], row
        assert row["tp"] == ((s >= row["threshold"]) & (y == 1)).sum()
        assert row["fp"] == ((s >= row["threshold"]) & (y == 0)).sum()
    for row in curves.operating_points(points).collect():
        y, s = samples[row["tool"]]
        kind, target = row["setting"].split("@")
        if row["threshold"] is None:
            assert kind == "Precision" and row["tp"] is None
            continue
        assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == len(y)
        assert (row["recall"] if kind == "Recall" else row["precision"]) >= float(target)
        assert row["tp"] == ((s >= row["threshold"]) & (y == 1)).sum()


@pytest.mark.parametrize("rule", ["aligned", "reference"])
def test_value_at_target(scored, samples, rule):
    points = curves.scored_curve(scored)
    for row in curves.precision_at_recall(points, rule=rule).collect():
        p, r, t = brute.pr(*samples[row["tool"]])
        ok = np.where(r >= 0.95)[0]
        best = ok[np.argmax(p[ok])]
        assert row["precision"] == p[best]
        assert row["threshold"] == (t[max(best - 1, 0)] if rule == "reference" else t[best])
    for row in curves.recall_at_precision(points, rule=rule).collect():
        p, r, t = brute.pr(*samples[row["tool"]])
        ok = np.where(p >= 0.90)[0]
        best = ok[np.argmax(r[ok])]
        assert row["recall"] == r[best]
        if rule == "reference":
            assert row["threshold"] == t[max(best - 1, 0)]
        else:
            assert row["threshold"] == (None if best == len(t) else t[best])


def test_curve_end_points(scored):
    points = curves.scored_curve(scored)
    roc = curves.roc_points(points).filter("threshold IS NULL").collect()
    assert len(roc) == 6 and all(r["fpr"] == r["tpr"] == 0 for r in roc)
    end = curves.pr_points(points).filter("threshold IS NULL").collect()
    assert len(end) == 6 and all(r["precision"] == 1 and r["recall"] == 0 for r in end)


def test_sweep(scored, samples):
    sweep = curves.threshold_sweep(scored).cache()
    table = {(r["tool"], r["threshold"]): r for r in sweep.collect()}
    for tool, (y, s) in samples.items():
        wanted = np.unique(np.r_[s, np.arange(201) / 200])
        mine = [k for k in table if k[0] == tool]
        assert sorted(t for _, t in mine) == sorted(wanted)
        for t in wanted[:: max(1, len(wanted) // 40)]:
            row = table[(tool, t)]
            assert row["tp"] == ((s >= t) & (y == 1)).sum() and row["fp"] == ((s >= t) & (y == 0)).sum()
    at_half = {r["tool"]: r for r in metrics.threshold_metrics(scored).collect()}
    for tool in samples:
        assert table[(tool, 0.5)]["f1"] == at_half[tool]["f1"]
        assert table[(tool, 0.5)]["tn"] == at_half[tool]["tn"]
    for row in curves.best_thresholds(sweep).collect():
        mine = [r for (tool, _), r in table.items() if tool == row["tool"]]
        best = max(r[row["criterion"]] for r in mine)
        assert row[row["criterion"]] == best
        assert row["threshold"] == min(r["threshold"] for r in mine if r[row["criterion"]] == best)


def test_grid(scored, samples):
    for row in curves.best_f1_on_grid(scored).collect():
        y, s = samples[row["tool"]]
        best, at = 0.0, 0.5
        for percent in range(5, 100, 5):
            called = s >= percent / 100
            tp = (called & (y == 1)).sum()
            f1 = 2 * tp / (called.sum() + (y == 1).sum())
            if f1 > best:
                best, at = f1, percent / 100
        assert (row["threshold"], row["f1"]) == (at, pytest.approx(best))


def test_nothing_found_on_grid(spark):
    frame = scored_frame(spark, {"t": ([0, 0, 1], [0.9, 0.8, 0.01])})
    row = curves.best_f1_on_grid(frame).first()
    assert (row["threshold"], row["f1"]) == (0.5, 0.0)


def test_single_class(spark):
    frame = scored_frame(spark, {"pos": ([1, 1], [0.2, 0.9]), "neg": ([0], [0.4]), "both": ([0, 1], [0.1, 0.9])})
    rows = {r["tool"]: r.asDict() for r in metrics.metrics_table(frame).collect()}
    for tool, n, rate in (("pos", 2, 1.0), ("neg", 1, 0.0)):
        row = rows[tool]
        assert row.pop("n_rows") == n and row.pop("positive_rate") == rate and row.pop("tool") == tool
        assert all(v is None for v in row.values())
    assert rows["both"]["auroc"] == 1.0
    zeros = {r["tool"]: r for r in metrics.metrics_table(frame, single_class="zeros").collect()}
    assert zeros["neg"]["specificity"] == 1.0 and zeros["pos"]["specificity"] == 0.0
    assert zeros["pos"]["f1"] == 0.0 and zeros["pos"]["auroc"] is None


def test_report_and_normalised_confusion(scored, samples):
    shares = metrics.confusion_normalised(scored).groupBy("tool", "label").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in shares)
    report = metrics.class_report(scored).filter("tool = 'ties'").collect()
    rows = {r["class"]: r for r in report}
    assert rows["0"]["support"] + rows["1"]["support"] == rows["macro avg"]["support"] == 400
    assert rows["macro avg"]["f1"] == pytest.approx((rows["0"]["f1"] + rows["1"]["f1"]) / 2)


def test_calibration(scored, samples):
    rows = distribution.calibration(scored).collect()
    for tool, (y, s) in samples.items():
        edges = np.percentile(s, np.arange(10, 100, 10))
        bins = np.array([(edges < v).sum() for v in s])
        mine = {r["bin"]: r for r in rows if r["tool"] == tool}
        if tool == "near_one":
            # Interpolated edges round onto scores one unit in the last place apart.
            assert sum(r["n_rows"] for r in mine.values()) == 400
            continue
        assert sorted(mine) == sorted(set(bins))
        for b, row in mine.items():
            assert row["n_rows"] == (bins == b).sum()
            assert row["mean_score"] == pytest.approx(s[bins == b].mean())
            assert row["positive_rate"] == pytest.approx(y[bins == b].mean())


def test_summary_and_histogram(scored, samples):
    for row in distribution.score_summary(scored).collect():
        y, s = samples[row["tool"]]
        values = s[y == row["label"]]
        q1, q2, q3 = np.percentile(values, [25, 50, 75])
        assert (row["q1"], row["median"], row["q3"]) == tuple(pytest.approx(q) for q in (q1, q2, q3))
        assert row["whisker_high"] == values[values <= q3 + 1.5 * (q3 - q1)].max()
        assert row["mean"] == pytest.approx(values.mean())
    total = distribution.score_histogram(scored).groupBy("tool", "label").agg(F.sum("density").alias("d")).collect()
    assert all(r["d"] == pytest.approx(20) for r in total)


def test_overlap(spark):
    calls = {"a": "12345", "b": "345", "c": "56"}
    rows = [(k, 1, 1.0 if k in keys else 0.1, t) for t, keys in calls.items() for k in "12345678"]
    frame = spark.createDataFrame(rows, "key string, label int, prob double, tool string")
    row = overlap.overlap_counts(frame, ["a", "b", "c"]).first()
    assert tuple(row) == (2, 0, 1, 2, 0, 0, 1, 6, False)
    assert sum(tuple(row)[:7]) == row["any_tool"]
    regions = {r["tools"]: r["keys"] for r in overlap.overlap_regions(frame, ["a", "b", "c"]).collect()}
    assert regions == {"a": 2, "c": 1, "a&b": 2, "a&b&c": 1}
    assert overlap.overlap_counts(frame.filter("tool = 'a'"), ["a", "b", "c"]).first()["degenerate"]


def test_top_errors(spark):
    rows = [(f"1:{i}:A:C", i % 2, (i * 7 % 10) / 10, "t") for i in range(100)] + [("nokey", 0, 1.0, "t")]
    frame = spark.createDataFrame(rows, "key string, label int, prob double, tool string")
    got = errors.top_errors(frame, 5)
    fp = [r["key"] for r in got.filter("err = 'FP'").orderBy("rank").collect()]
    assert fp == [k for k, *_ in sorted((r for r in rows if r[1] == 0), key=lambda r: (-r[2], r[0]))[:5]]
    fn = [r["key"] for r in got.filter("err = 'FN'").orderBy("rank").collect()]
    assert fn == [k for k, *_ in sorted((r for r in rows if r[1] == 1), key=lambda r: (r[2], r[0]))[:5]]
    assert errors.loci(got).count() == 9
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


# Published results: two score levels and four counts are the whole data set.
@pytest.mark.parametrize(
    "tp,fp,expected",
    [
        (1172, 14, dict(auroc=0.5141, auprc=0.7307, f1=0.0555, precision=0.9882, recall=0.0285, specificity=0.9997)),
        (1173, 63, dict(auroc=0.5136, auprc=0.7112, f1=0.0555, precision=0.9490, recall=0.0286, specificity=0.9987)),
    ],
)
def test_published_counts(spark, tp, fp, expected):
    positives, negatives = 41069, 48635
    counts = spark.createDataFrame(
        [("t", 1.0, tp, fp), ("t", 0.0, positives - tp, negatives - fp)], "tool string, score double, pos bigint, neg bigint"
    )
    points = curves.curve(counts)
    row = metrics.metrics_from_curve(points).first()
    for name, value in expected.items():
        assert round(row[name], 4) == value, name
    assert row["n_rows"] == 89704 and round(row["positive_rate"], 4) == 0.4578
    assert round(row["prec_at_r95"], 4) == 0.4578
    assert round(row["rec_at_p90"], 4) == expected["recall"]
    at = {r["setting"]: r for r in curves.operating_points(points, rule="reference").collect()}
    assert (at["Recall@0.95"]["threshold"], at["Recall@0.95"]["tp"], at["Recall@0.95"]["fp"]) == (0.0, positives, negatives)
    last = at["Precision@0.98"]
    if fp == 63:
        # No threshold reaches 0.98: the end point of the curve decides, at the highest score.
        assert (last["threshold"], last["tp"], last["fp"], last["tn"], last["fn"]) == (1.0, 1173, 63, 48572, 39896)
        assert round(last["precision"], 6) == 0.949029
    for row in at.values():
        assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == 89704


def test_published_accuracy(spark):
    counts = [("a", 1, 0.9, 40648), ("b", 0, 0.1, 129541), ("c", 0, 0.9, 21915), ("d", 1, 0.1, 529)]
    frame = spark.createDataFrame(counts, "key string, label int, prob double, n int")
    rows = frame.select("key", "label", "prob", F.lit("t").alias("tool"), F.explode(F.sequence(F.lit(1), "n")))
    row = metrics.threshold_metrics(rows).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (40648, 129541, 21915, 529)
    assert round(row["accuracy"], 6) == 0.883488


def test_large_counts_stay_exact(spark):
    half = 10**12
    counts = spark.createDataFrame([("t", 0.5, half, half)], "tool string, score double, pos bigint, neg bigint")
    assert curves.areas(curves.curve(counts)).first()["auroc"] == 0.5

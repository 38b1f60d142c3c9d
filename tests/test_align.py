import pytest
from pyspark.sql import functions as F

from callscope.operators import align, resample, scores, strata

VARIANTS = [("k1", 0, 0), ("k1", 1, 1), ("k2", 1, 1), ("k3", 0, 0), ("k3", 0, 0)]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame(VARIANTS, "key string, label int, src_rank int")


@pytest.mark.parametrize(
    "conflict,expected",
    [("first", {"k1": 0, "k2": 1, "k3": 0}), ("positive", {"k1": 1, "k2": 1, "k3": 0}), ("drop", {"k2": 1, "k3": 0})],
)
def test_conflicts(labelled, conflict, expected):
    assert {r["key"]: r["label"] for r in align.truth_labels(labelled, conflict).collect()} == expected
    assert [tuple(r) for r in align.label_conflicts(labelled).collect()] == [("k1", 1, 1)]
    with pytest.raises(ValueError):
        align.truth_labels(labelled, "other")


def test_universe(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "key string, label int")
    calls = spark.createDataFrame(
        [("x", "a", "0.4", 2), ("x", "a", "1.7", 1), ("x", "z", "0.9", 1), ("y", "b", "bad", 1), ("y", "c", "-3", 1)],
        "tool string, key string, prob string, ord int",
    )
    got = {(r["tool"], r["key"]): r["prob"] for r in align.align_universe(truth, calls, ["x", "y", "none"]).collect()}
    assert len(got) == 9 and got[("x", "a")] == 1.0 and sum(got.values()) == 1.0
    first = align.align_universe(truth, calls.withColumn("ord", -F.col("ord")), ["x"], "first", "ord")
    assert {r["key"]: r["prob"] for r in first.collect()} == {"a": 0.4, "b": 0.0, "c": 0.0}


def test_label_and_clean(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "key string, label int")
    calls = spark.createDataFrame(
        [("t", "a", 0.1), ("t", "a", 0.9), ("t", "z", 0.5)], "tool string, key string, prob double"
    )
    got = {r["key"]: (r["prob"], r["label"]) for r in align.label_calls(calls, truth, ["prob"]).collect()}
    assert got == {"a": (0.1, 1), "z": (0.5, None)}
    assert [tuple(r) for r in align.clean_by_key(calls, truth).collect()] == [("a", 0.9, 1)]
    assert [r[0] for r in align.keys_without_truth(calls, truth).collect()] == ["z"]
    labelled = align.label_calls(calls, truth, ["prob"])
    assert align.drop_unlabelled(labelled).count() == 1
    assert tuple(align.unlabelled_report(labelled).first()) == (2, 1)


def test_pairs_must_match(spark):
    rows = [("a", 1, 0.1, "x"), ("a", 1, 0.2, "y"), ("b", 0, 0.3, "x")]
    frame = spark.createDataFrame(rows, "key string, label int, prob double, tool string")
    assert align.paired_scores(frame.filter("key = 'a'"), "x", "y").first() == ("a", 1, 0.1, 0.2)
    with pytest.raises(Exception, match="not aligned"):
        align.paired_scores(frame, "x", "y").collect()


def test_cyclic_zip(spark):
    predictions = spark.range(7).select(F.col("id").alias("index"))
    mapping = spark.range(3).select(F.col("id").alias("row"), F.concat(F.lit("m"), "id").alias("name"))
    got = [r["name"] for r in align.cyclic_zip(predictions, mapping, on_mismatch="cycle").orderBy("index").collect()]
    assert got == ["m0", "m1", "m2", "m0", "m1", "m2", "m0"]
    with pytest.raises(Exception, match="differ in length"):
        align.cyclic_zip(predictions, mapping).collect()
    with pytest.raises(Exception, match="empty"):
        align.cyclic_zip(predictions, mapping.filter("row < 0"), on_mismatch="cycle").collect()
    assert align.cyclic_zip(predictions.filter("index < 3"), mapping).count() == 3


def test_score_chain(spark):
    frame = spark.createDataFrame(
        [("10", "3,1", 20.0, "PASS"), ("x", "0,0", 0.0, "weak"), ("30", "1", None, None)],
        "TLOD string, AD string, QUAL double, FILTER string",
    )
    assert [r["prob"] for r in scores.score_chain(frame, "tlod").collect()] == [0.0, 0.0, 1.0]
    assert [r["prob"] for r in scores.score_chain(frame.drop("TLOD"), "tlod").collect()] == [0.25, 0.0, 0.0]
    logistic = [r["prob"] for r in scores.score_chain(frame.select("QUAL"), "somaticevs").collect()]
    assert logistic == [pytest.approx(0.880797), 0.5, 0.0]
    # Nothing usable: presence decides.
    assert [r["prob"] for r in scores.caller_score(frame.select("FILTER")).collect()] == [1.0, 0.5, 0.5]
    assert [r["prob"] for r in scores.caller_score(frame.select("AD").withColumnRenamed("AD", "other")).collect()] == [1.0] * 3
    # A score column counts by default, is ignored by a chain that does not name it.
    scored = frame.select(F.lit(3.0).alias("score"), "QUAL")
    assert [r["prob"] for r in scores.score_chain(scored).collect()] == [3.0] * 3
    assert scores.score_chain(scored, "tlod").first()["prob"] == pytest.approx(0.880797)
    assert scores.score_chain(frame.select("FILTER"), "simple").first()["prob"] == 0.5


def test_minmax(spark):
    frame = spark.createDataFrame([("2",), ("4",), (None,), ("inf",)], "v string")
    assert [r["v"] for r in scores.minmax_scale(frame, "v").collect()] == [0.0, 1.0, None, None]
    constant = spark.createDataFrame([("7",), (None,)], "v string")
    assert [r["v"] for r in scores.minmax_scale(constant, "v").collect()] == [7.0, 0.0]


def test_annotations_first_source_wins_even_if_missing(spark):
    schema = "key string, vaf_est double, depth_est double"
    one = spark.createDataFrame([("a", None, None), ("b", 0.1, 10.0)], schema)
    two = spark.createDataFrame([("a", 0.5, 5.0), ("c", 0.3, None)], schema)
    got = {r["key"]: (r["vaf_est"], r["depth_est"]) for r in strata.consolidate_annotations([one, two]).collect()}
    assert got == {"a": (None, None), "b": (0.1, 10.0), "c": (0.3, None)}


def test_tied_tertiles(spark):
    frame = spark.createDataFrame([(5.0,)] * 9 + [(6.0,), (None,)], "d double")
    row = strata.tertile_edges(frame, "d").first()
    assert tuple(row) == (5.0, 5.0 + 1e-9, 5.0 + 2e-9, 6.0)
    bins = {(r["d"], r["depth_bin"]) for r in strata.depth_tertile(frame, "d").collect()}
    assert bins == {(5.0, "low"), (6.0, "high"), (None, None)}


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("k"), "id").alias("key"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.round(F.rand(3) * 0.6 + (F.col("id") % 3 == 0).cast("int") * 0.3, 2).alias("a"),
        F.round(F.rand(4) * 0.8 + (F.col("id") % 3 == 0).cast("int") * 0.1, 2).alias("b"),
    )
    tools = F.array(
        F.struct(F.col("a").alias("prob"), F.lit("a").alias("tool")), F.struct(F.col("b").alias("prob"), F.lit("b").alias("tool"))
    )
    return rows.select("key", "label", F.inline(tools)).cache()


def test_samples(scored):
    rows = scored.filter("tool = 'a'")
    balanced = resample.balanced_sample(rows).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in balanced} == {0: 200, 1: 200}
    again = resample.balanced_sample(rows.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, resample.balanced_sample(rows).collect()))
    weighted = {r["label"]: r["count"] for r in resample.weighted_resample(rows).groupBy("label").count().collect()}
    assert sum(weighted.values()) == 600 and abs(weighted[0] - 300) < 80
    with pytest.raises(Exception, match="both classes"):
        resample.balanced_sample(rows.filter("label = 0")).collect()
    split = {r["split"]: r["count"] for r in resample.hash_split(rows).groupBy("split").count().collect()}
    assert abs(split["train"] - 480) < 50


def test_bootstrap(scored):
    by_key = {r["tool"]: r for r in resample.bootstrap_areas(scored, 60, 1).collect()}
    stratified = {r["tool"]: r for r in resample.bootstrap_stratified(scored, 40, 1).collect()}
    for tool in "ab":
        k, s = by_key[tool], stratified[tool]
        assert k["auroc"] == pytest.approx(s["auroc"])
        assert k["auroc_lo"] < k["auroc"] < k["auroc_hi"] and k["auprc_lo"] < k["auprc"] < k["auprc_hi"]
        assert abs(s["auroc_lo"] - k["auroc_lo"]) < 0.03 and abs(s["auroc_hi"] - k["auroc_hi"]) < 0.03
    delta = resample.paired_bootstrap_delta(scored, "a", "b", 60, 1).first()
    assert delta["delta_auroc"] == pytest.approx(by_key["a"]["auroc"] - by_key["b"]["auroc"])
    assert delta["delta_auroc_lo"] < delta["delta_auroc"] < delta["delta_auroc_hi"] and delta["reps_used"] == 60


@pytest.mark.parametrize("part_rows", [40, 16_384])
def test_replicates_against_plain_sums(spark, monkeypatch, part_rows):
    """Ties within and across blocks, a shared score, scores outside [0, 1] and a one-class tool."""
    import random

    import numpy as np

    from callscope.functions.hashing import poisson_weights, with_digest
    from callscope.operators import replicates

    monkeypatch.setattr(replicates, "BLOCK", 7)
    monkeypatch.setattr(replicates, "PART_ROWS", part_rows)
    draw, rows = random.Random(3), []
    for k in range(900):
        score = draw.choice([0.0, 0.0, 1.0, draw.randint(0, 20) / 20, draw.random(), -2.5, 7.0])
        rows += [("a", f"k{k}", k % 3 == 0, score), ("b", f"k{k}", k % 3 == 0, draw.random()), ("c", f"k{k}", True, 0.5)]
    frame = spark.createDataFrame([(t, k, int(y), s) for t, k, y, s in rows], "tool string, key string, label int, prob double")
    got = {(r["tool"], r["rep"]): (r["auroc"], r["auprc"]) for r in replicates.replicate_areas(frame, ["tool"], 70, 5).collect()}
    assert {t for t, _ in got} == {"a", "b"} and len(got) == 2 * 71
    for tool in "ab":
        own = with_digest(frame.filter(f"tool = '{tool}'")).collect()
        weight = poisson_weights(np.array([r["_h"] for r in own]), np.array([r["_l"] for r in own]), 70, 5)
        for rep in (-1, 0, 33, 69):
            by = {}
            for r, w in zip(own, weight[:, rep + 1].tolist()):
                cell = by.setdefault(r["prob"], [0, 0])
                cell[1 - r["label"]] += w
            tp = fp = pairs = area = 0
            for _, (pos, neg) in sorted(by.items(), reverse=True):
                before = tp / (tp + fp) if tp + fp else 1.0
                pairs += neg * (tp + pos / 2)
                tp, fp = tp + pos, fp + neg
                area += pos * ((tp / (tp + fp) if pos else 0) + before) / 2
            assert got[tool, rep] == (pytest.approx(pairs / (tp * fp)), pytest.approx(area / tp))


def test_bootstrap_of_a_tool_with_itself_is_zero(scored):
    twin = scored.filter("tool = 'a'").unionByName(scored.filter("tool = 'a'").withColumn("tool", F.lit("c")))
    row = resample.paired_bootstrap_delta(twin, "a", "c", 10, 1).first()
    assert row["delta_auroc_lo"] == row["delta_auroc_hi"] == row["delta_auprc_hi"] == 0.0


def test_areas_do_not_depend_on_where_parts_begin(scored, monkeypatch):
    from callscope.operators import replicates

    found = []
    for part_rows, block in ((37, 7), (16_384, 64)):
        monkeypatch.setattr(replicates, "PART_ROWS", part_rows)
        monkeypatch.setattr(replicates, "BLOCK", block)
        found.append({r["rep"]: r[1:] for r in replicates.replicate_areas(scored.filter("tool = 'a'"), ["tool"], 50, 1).collect()})
    assert len(found[0]) == 51 and found[0] == found[1]


def test_rows_reach_python_without_nested_columns(spark, scored):
    """Null arrays and structs cost many times the numbers on that way."""
    from callscope.operators import replicates

    rows = replicates.scored_rows(scored, ["tool"]).withColumn("part", F.lit(0)).withColumn("lead", F.lit(None).cast(replicates.LEAD))
    down = replicates._down(rows, replicates._Sums, replicates.SUMS, replicates.poisson_draws(3, 1))
    sent = down._jdf.queryExecution().analyzed().children().head().schema().simpleString()
    assert "array<" not in sent and sent.count("struct<") == 1
    assert sum(len(r["pos"]) for r in down.collect()) >= 8


def test_deltas_take_the_areas_down_once(spark, scored, monkeypatch):
    seen, stored = [], resample.durable
    monkeypatch.setattr(resample, "durable", lambda df: seen.append(df.columns) or stored(df))
    resample.paired_bootstrap_delta(scored, "a", "b", 5, 1)
    assert ["tool", "rep", "auroc", "auprc"] in seen


@pytest.mark.parametrize("shared", [False, True])
def test_parts_of_a_narrow_band_stay_small(spark, monkeypatch, shared):
    """Scores of less than one coarse cell, or all rows at one score."""
    import random

    from callscope.operators import replicates

    monkeypatch.setattr(replicates, "PART_ROWS", 100)
    draw, seen = random.Random(1), []
    rows = [("a", f"k{k}", k % 3 // 2, 0.3 if shared else 0.3 + draw.random() * 0.0004) for k in range(4000)]
    frame = spark.createDataFrame(rows, "tool string, key string, label int, prob double")
    down = replicates._down

    def watched(rows, *rest):
        seen.append(max(r["count"] for r in rows.groupBy("part").count().collect()))
        return down(rows, *rest)

    monkeypatch.setattr(replicates, "_down", watched)
    got = {r["rep"]: r for r in replicates.replicate_areas(frame, ["tool"], 5, 1).collect()}
    assert len(seen) == 2 and max(seen) <= 300
    by_score = sorted({r[3] for r in rows}, reverse=True)
    tp = pairs = 0
    for score in by_score:
        own = [r[2] for r in rows if r[3] == score] if shared else [next(r[2] for r in rows if r[3] == score)]
        pairs += own.count(0) * (tp + own.count(1) / 2)
        tp += own.count(1)
    assert got[-1]["auroc"] == pytest.approx(pairs / (tp * (4000 - tp)))


@pytest.mark.parametrize("spare", [8.0, -60.0])
def test_stratified_draws_keep_class_sizes(spark, monkeypatch, spare):
    """Also where the Poisson weights exceed the class, so that all keys are drawn one by one."""
    import numpy as np

    monkeypatch.setattr(resample, "SPARE", spare)
    monkeypatch.setattr(resample, "DRAWS", 7)
    rows = [("a", f"k{k}", int(k < 130), (k * 37 % 500) / 500 + 0.3 * (k < 130)) for k in range(500)]
    frame = spark.createDataFrame(rows, "tool string, key string, label int, prob double")
    caught = {}
    weighted = resample.weighted_areas

    def watched(rows, draws):
        caught["rows"] = rows.select("prob", "label", "h", "l", "extra").collect()
        caught["draws"] = draws
        return weighted(rows, draws)

    monkeypatch.setattr(resample, "weighted_areas", watched)
    found = resample.bootstrap_stratified(frame, 60, 3).first()
    own, draws = caught["rows"], caught["draws"]
    number = lambda name: np.array([r[name] or 0 for r in own], np.int64)
    label = number("label")
    weight = draws.weights(label, number("h"), number("l"), [r["extra"] for r in own])
    assert (weight[label == 1].sum(axis=0) == 130).all() and (weight[label == 0].sum(axis=0) == 370).all()
    assert any(draws.off) == (spare < 0)
    prob, areas = np.array([r["prob"] for r in own]), []
    for rep in range(1, 61):
        w = weight[:, rep]
        above = (prob[label == 1][:, None] > prob[label == 0][None, :]) + 0.5 * (prob[label == 1][:, None] == prob[label == 0][None, :])
        areas.append((w[label == 1] @ above @ w[label == 0]) / (130 * 370))
    assert found["reps_used"] == 60
    assert found["auroc_lo"] == pytest.approx(np.percentile(areas, 2.5)) and found["auroc_hi"] == pytest.approx(np.percentile(areas, 97.5))
    # The spread is that of drawing each class with replacement.
    draw = np.random.default_rng(1)
    y, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pairs = (x[y == 1][:, None] > x[y == 0][None, :]) * 1.0
    free = [pairs[np.ix_(draw.integers(0, 130, 130), draw.integers(0, 370, 370))].mean() for _ in range(400)]
    assert 0.6 < np.std(areas) / np.std(free) < 1.5

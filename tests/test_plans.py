"""Whole comparisons, and what the physical plans must (not) contain."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import curves, resample
from callscope.plans import prepare, thresholds, views
from callscope.plans.compare import Comparison
from callscope.session import durable

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scored(spark):
    return durable(views.scored(spark, SF))


def test_comparison(spark, tmp_path):
    truth = views.truth(spark, SF)
    raw = views.calls_raw(spark, SF).withColumn("key", F.col("id").cast("string"))
    model = views.calls(spark, SF).filter("tool = 'model'").select("key", "prob")
    tables = {"model": model, "by_tlod": raw.select("key", "tlod", "ad"), "by_qual": raw.select("key", "qual", "filter")}
    whole = Comparison.from_tables(truth, tables, {"by_tlod": "tlod", "by_qual": "tlod"})
    table = {r["tool"]: r for r in whole.metrics().collect()}
    assert set(table) == set(tables) and all(r["n_rows"] == truth.count() for r in table.values())
    whole.write(str(tmp_path), reps=5)
    written = {p.name for p in tmp_path.iterdir()}
    assert {"performance_metrics", "operating_points", "delta_metrics_bootstrap", "stratified", "top_errors_by_tool"} <= written
    assert spark.read.csv(str(tmp_path / "delta_metrics_bootstrap"), header=True).count() == 2


def test_curve_plan_is_distributed(scored):
    plan = plan_of(curves.areas(curves.scored_curve(scored)))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    # Every window over scores is confined to a cell; only cell totals are ordered per tool.
    for line in plan.splitlines():
        if "Window [" in line and "score#" in line:
            assert "_c2#" in line


def test_bootstrap_plan(scored):
    plan = plan_of(resample.bootstrap_areas(scored, 5, 1))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Keys are shuffled by cell, twice; replicates only exist beside cells, never beside keys.
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line and "rep" in line:
            assert "h#" not in line


def test_threshold_plans(scored):
    model = scored.filter("tool = 'model'")
    best = thresholds.best_on_balanced(model).first()
    assert 0.05 <= best["threshold"] <= 0.95
    shares = thresholds.confusion_at_best(model).groupBy("label").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in shares)


def test_evaluation_file(scored, tmp_path):
    prepare.write_evaluation(scored.filter("tool = 'model'"), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part-*"))
    assert [line.split("=")[0] for line in text.split()] == ["AUROC", "AP", "ACC@0.5", "TP", "TN", "FP", "FN"]


def test_preparation(spark):
    variants = prepare.labelled_variants(
        spark.createDataFrame([("1", 20, "A", "C"), ("1", 40, "G", "T")], "chrom string, pos bigint, ref string, alt string"),
        spark.createDataFrame([("1", 40, "G", "T"), ("1", 60, "A", "G")], "chrom string, pos bigint, ref string, alt string"),
    )
    reads = spark.createDataFrame(
        [("1", 15, 25, [("M", 10)], "C" * 10, None, 50, False, 0)] * 3,
        "chrom string, start bigint, end bigint, cigar array<struct<op:string,len:int>>, seq string, "
        "quals array<int>, mapq int, is_reverse boolean, flag int",
    )
    signal = spark.createDataFrame([("1", 0, 100, 2.0)], "chrom string, start bigint, end bigint, value double")
    table = {r["key"]: r for r in prepare.evidence_table(variants, reads, signal, signal, 5).collect()}
    assert set(table) == {"1:20:A:C", "1:40:G:T", "1:60:A:G"}
    assert table["1:20:A:C"]["DP"] == 3 and table["1:20:A:C"]["AD"] == 3 and table["1:20:A:C"]["SB"] == 1
    assert table["1:60:A:G"]["DP"] == 0 and table["1:60:A:G"]["MAP"] == 2.0

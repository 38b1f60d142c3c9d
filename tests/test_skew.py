import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.operators import errors, features, skew


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def bag(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(2)
    hot = [("hot", k) for k in range(1500)] + [(None, k) for k in range(700)]
    rest = [(f"k{draw.randint(0, 400)}", 5000 + k) for k in range(2000)]
    left = spark.createDataFrame(hot + rest + rest[:40], "key string, n int")
    right = spark.createDataFrame([("hot", 1.0), (None, 9.0)] + [(f"k{k}", float(k)) for k in range(300)], "key string, x double")
    return left, right


@pytest.mark.parametrize("parts", [4, 64, 4096])
def test_equals_plain_join(sides, parts):
    left, right = sides
    got = skew.left_join(left, right, ["key"], parts)
    want = left.join(right, "key", "left")
    assert got.columns == want.columns and bag(got) == bag(want)


def test_hot_keys_are_split(spark, sides, monkeypatch):
    left, right = sides
    salted = {}
    join = type(left).join

    def watched(self, other, on=None, how=None):
        if on == ["key", "_salt"]:
            salted["left"], salted["right"] = self, other
        return join(self, other, on, how)

    monkeypatch.setattr(type(left), "join", watched)
    skew.left_join(left, right, ["key"], 64)
    share = left.count() / 64
    sizes = {tuple(r)[:2]: r["count"] for r in salted["left"].groupBy("key", "_salt").count().collect()}
    assert max(sizes.values()) < 2.5 * share < 1500
    assert sum(key == "hot" for key, _ in sizes) > 15 and sum(key is None for key, _ in sizes) > 30
    assert salted["right"].count() < right.count() + 2 * 64
    assert {r["key"] for r in salted["right"].filter("_salt > 0").select("key").collect()} <= {"hot"} | {f"k{k}" for k in range(400)}


def test_plan_shuffles_by_key_and_salt(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(skew.left_join(left, right, ["key"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert any("hashpartitioning(key" in line and "_salt" in line for line in plan.splitlines())


def test_two_keys_and_odd_columns(spark):
    left = spark.createDataFrame([("a", 1, {"x": 1}, [1]), ("a", None, None, None), (None, 1, {}, [2])] * 3,
                                 "c string, b int, m map<string,int>, l array<int>")
    right = spark.createDataFrame([("a", 1, "r")], "c string, b int, text string")
    assert bag(skew.left_join(left, right, ["c", "b"], 2)) == bag(left.join(right, ["c", "b"], "left"))
    empty = left.limit(0)
    assert skew.left_join(empty, right, ["c", "b"]).collect() == []
    assert bag(skew.left_join(left, right.limit(0), ["c", "b"])) == bag(left.join(right.limit(0), ["c", "b"], "left"))


def test_features_of_a_hot_variant(spark):
    variants = spark.createDataFrame([("v", k) for k in range(300)] + [("w", 1)], "key string, n int")
    evidence = spark.createDataFrame([("v", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)],
                                     "key string, DP double, AD double, VAF double, MQ double, SB double, MAP double, RTIM double")
    rows = features.feature_join(variants, evidence)
    assert rows.count() == 301 and rows.filter("DP = 1.0 AND RTIM = 7.0").count() == 300


def brute_errors(rows, n):
    out = []
    for tool in {r[0] for r in rows}:
        for label, name in ((0, "FP"), (1, "FN")):
            own = [r for r in rows if r[0] == tool and r[2] == label]
            own.sort(key=lambda r: (r[3] is not None, (-r[3] if label == 0 else r[3]) if r[3] is not None else 0, r[1]))
            out += [(tool, name, k + 1, r[1], r[3]) for k, r in enumerate(own[:n])]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 20, 700, 100_000])
@pytest.mark.parametrize("part_rows", [50, 1_000_000])
def test_top_errors_by_selection(spark, monkeypatch, n, part_rows):
    """A third of all rows at one score, near ones inside one cell, missing scores, small groups."""
    monkeypatch.setattr(errors, "PART_ROWS", part_rows)
    draw, rows = random.Random(7), []
    for k in range(1500):
        score = draw.choice([0.0, 1.0, 0.3 + draw.random() * 1e-5, draw.random(), -0.5])
        rows.append(("a", f"k{k:04}", draw.randint(0, 1), score))
    rows += [("b", "x", 0, 0.5), ("b", "y", 1, None), ("b", "z", 1, 0.25), ("b", "u", None, 0.1)]
    frame = spark.createDataFrame(rows, "tool string, key string, label int, prob double")
    got = errors.top_errors(frame, n).select("tool", "err", "rank", "key", "prob")
    assert bag(got) == brute_errors(rows, n)


def test_top_errors_plan_does_not_depend_on_n(spark):
    """But for the limit that Spark itself puts inside a part for a small n."""
    frame = spark.range(1000).select(F.lit("a").alias("tool"), F.col("id").cast("string").alias("key"),
                                     (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 1000).alias("prob"))
    plans = [plan_of(errors.top_errors(frame, n)) for n in (20, 1_000_000)]
    steps = [re.findall(r"^[\W\d]*([A-Za-z]+)", plan, re.MULTILINE) for plan in plans]
    shuffles = [[x for x in own if x in ("Exchange", "Window", "BroadcastHashJoin", "SortMergeJoin", "HashAggregate")] for own in steps]
    assert shuffles[0] == shuffles[1] and "Exchange" in shuffles[0]

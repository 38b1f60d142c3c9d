import pytest
from pyspark.sql import functions as F

from callscope.functions import keys, numeric, sequence
from callscope.functions.hashing import POISSON_ONE_CDF, with_digest, with_draw, with_index, with_poisson


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,expected",
    [("chr1", "1"), ("1", "1"), ("chrX", "X"), ("chrchr1", "chr1"), ("hs_chr1", "hs_chr1"), ("chr", "")],
)
def test_chrom(spark, raw, expected):
    assert one(spark, keys.norm_chrom(F.lit(raw))) == expected


@pytest.mark.parametrize("raw,expected", [("a", "A"), ("A,T", "A"), ("A;T", "A"), ("g;t,c", "G"), ("-", "-"), (",T", "")])
def test_allele(spark, raw, expected):
    assert one(spark, keys.norm_allele(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [("123.0", "123"), ("123", "123"), ("123.9", "123"), ("007", "7"), ("1e3", "1e3"), ("-5", "-5"), ("x", "x"), ("1.", "1."), ("0.5", "0")],
)
def test_pos(spark, raw, expected):
    assert one(spark, keys.norm_pos(F.lit(raw))) == expected


def test_key_keeps_null(spark):
    row = spark.createDataFrame([("chr1", None, "a", "c")], "chrom string, pos bigint, ref string, alt string")
    assert row.select(keys.variant_key().alias("k")).first()["k"] is None


def test_key_roundtrip(spark):
    frame = spark.createDataFrame([("1:5:A:C",), ("weird",), ("2:x:A:C",)], "key string")
    rows = [tuple(r) for r in frame.select(*keys.split_key()).collect()]
    assert rows == [("1", 5, "A", "C"), ("weird", None, None, None), ("2", None, "A", "C")]


def test_number_and_clip(spark):
    values = ["1.5", "x", "NaN", "Infinity", "-3", None, ""]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(numeric.to_number("v")).collect()]
    assert got == [1.5, None, None, None, -3.0, None, None]
    clipped = [r[0] for r in frame.select(numeric.clip(numeric.to_number("v"), 0.0, 1.0)).collect()]
    assert clipped == [1.0, None, None, None, 0.0, None, None]


def test_allele_fraction(spark):
    frame = spark.createDataFrame([("3", "1"), ("0", "0"), ("-2", "1"), ("x", "1")], "r string, a string")
    got = [tuple(r) for r in frame.select(numeric.allele_fraction("r", "a"), numeric.allele_depth("r", "a")).collect()]
    assert got == [(0.25, 4.0), (None, 0.0), (1.0, 1.0), (None, None)]


@pytest.mark.parametrize("text,expected", [("3,1", 0.25), ("3:1", 0.25), ("3;1", 0.25), ("3", None), ("", None)])
def test_count_pair(spark, text, expected):
    ref, alt = numeric.count_pair(F.lit(text))
    assert one(spark, numeric.allele_fraction(ref, alt)) == expected


def test_bins(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.1999, 0.2, 1.0, 1.01, None)], "v double")
    got = [r[0] for r in frame.select(numeric.fixed_bin("v")).collect()]
    assert got == ["<5%", "5-10%", "10-20%", ">=20%", ">=20%", None, None]
    edges = [F.lit(e) for e in (1.0, 2.0, 3.0, 4.0)]
    frame = spark.createDataFrame([(v,) for v in (0.9, 1.0, 2.0, 2.1, 4.0, 4.1)], "v double")
    got = [r[0] for r in frame.select(numeric.right_closed_bin("v", edges)).collect()]
    assert got == [None, "low", "low", "med", "high", None]


def test_one_hot_and_transpose(spark):
    frame = spark.createDataFrame([("acGNt",)], "s string")
    hot = frame.select(sequence.one_hot("s").alias("h")).first()["h"]
    assert [list(r) for r in hot] == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 0, 1]]
    turned = frame.select(sequence.transpose(sequence.one_hot("s")).alias("t")).first()["t"]
    assert len(turned) == 5 and list(turned[0]) == [1, 0, 0, 0]
    both = frame.select(
        sequence.channels_first(sequence.transpose(sequence.one_hot("s"))).alias("a"),
        sequence.channels_first(sequence.one_hot("s")).alias("b"),
    ).first()
    assert both["a"] == both["b"] == hot


def test_draws_are_fair(spark):
    keyed = with_digest(spark.range(4000).selectExpr("CAST(id AS STRING) AS key"))
    reps = keyed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    weights = with_poisson(reps, "w", F.col("rep"), 7)
    row = weights.agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert abs(row[0] - 1) < 0.02 and abs(row[1] - 1) < 0.04 and abs(row[2] - POISSON_ONE_CDF[0]) < 0.01
    index = with_index(keyed, "i", 0, 7, F.lit(10).cast("bigint")).groupBy("i").count().collect()
    assert len(index) == 10 and all(300 < r["count"] < 500 for r in index)
    # Pairs of streams are uncorrelated.
    wide = with_draw(with_draw(keyed, "a", 0, 7), "b", 1, 7)
    assert abs(wide.agg(F.corr("a", "b")).first()[0]) < 0.06


def test_draw_filter_stays_small(spark):
    keyed = with_digest(spark.range(10).selectExpr("CAST(id AS STRING) AS key"))
    plan = with_poisson(keyed.withColumn("rep", F.lit(3)), "w", F.col("rep"), 7).filter("w > 0")
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20000

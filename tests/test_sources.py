import gzip

import pytest
from pyspark.sql import functions as F

from callscope.functions.keys import variant_key
from callscope.sources import columns, fasta, schemas, sinks, tables, variants

MAF = "Hugo\tChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\tNCBI_Build\n"


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_maf(spark, folder):
    (folder / "a.maf").write_text("#version 2\n" + MAF + "G\tchr1\t10\tA\tC\tGRCh38\nG\tchr1\t11\tA\tC\tGRCh37\n#x\nG\tX\t12\t-\tC\tGRCh38\n")
    with gzip.open(folder / "b.maf.gz", "wt") as out:
        out.write("NCBI_Build\ttumor_seq_allele2\treference_allele\tSTART_POSITION\tchromosome\nGRCh38\tT\tG\t99\t2\n")
    got = sorted(tuple(r)[:5] for r in variants.read_maf(spark, str(folder)).collect())
    assert got == [("1", 10, "A", "C", 0), ("2", 99, "G", "T", 0), ("X", 12, "-", "C", 0)]
    (folder / "c.maf").write_text("Chromosome\tStart_Position\n1\t5\n")
    with pytest.raises(Exception, match="required columns missing"):
        variants.read_maf(spark, str(folder)).collect()


def test_truth_vcf(spark, folder):
    (folder / "t.vcf").write_text("##x\n#CHROM\tPOS\nchr3\t7\t.\tA\tC,G\t.\t.\t.\n4\t8\t.\tAT\tA\t.\t.\t.\n")
    got = sorted(tuple(r)[:5] for r in variants.read_truth_vcf(spark, str(folder / "t.vcf")).collect())
    assert got == [("3", 7, "A", "C", 1), ("3", 7, "A", "G", 1), ("4", 8, "AT", "A", 1)]


LINES = [
    "chr1\t1\t.\tA\tC\t50\tPASS\tDP=3;AF=0.25",
    "chr1\t2\t.\tA\tC\t50\tPASS\tMAF=0.2;AF=0.1",
    "chr1\t3\t.\tA\tC,G\t.\tPASS\tAF=0.3,0.4;DP=1",
    "chr1\t4\t.\tA\tC\t60\tPASS\tDP=3",
    "chr1\t5\t.\tA\tC\t.\tPASS\tDP=3",
    "chr1\t6\t.\tA",
    "chr1\tx\t.\tA\tC\t.\tPASS\tDP=3",
    "chr1\t8\t.\tA\tC\t.\tPASS\tAF=1e",
    "chr1\t9\t.\tA\tC\tabc\tPASS\tDP=1",
]


def test_caller_vcf(spark, folder):
    with gzip.open(folder / "c.vcf.gz", "wt") as out:
        out.write("##head\n" + "\n".join(LINES) + "\n")
    good, bad = variants.read_vcf(spark, str(folder / "c.vcf.gz"))
    got = sorted((r["pos"], r["alt"], r["score"]) for r in good.collect())
    assert got == [(1, "C", 0.25), (2, "C", 0.1), (3, "C", 0.3), (3, "G", 0.4), (4, "C", 60.0), (5, "C", 0.0)]
    reasons = sorted((r["line"].split("\t")[1], r["reason"]) for r in bad.collect())
    assert reasons == [
        ("6", "short line"), ("8", "score is not a number"), ("9", "score is not a number"), ("x", "position is not a number"),
    ]
    loose, _ = variants.read_vcf(spark, str(folder / "c.vcf.gz"), strict=False)
    got = sorted((r["pos"], r["alt"], r["score"]) for r in loose.collect())
    assert got == [(1, "C", 0.25), (2, "C", 0.2), (3, "C", 0.3), (3, "G", 0.3), (4, "C", 60.0), (5, "C", 0.0)]


def test_find_column():
    assert columns.find_column(["#CHROM", "POS"], columns.SYNONYMS["chrom"]) == "#CHROM"
    assert columns.find_column(["my_position_bp"], columns.SYNONYMS["pos"]) == "my_position_bp"
    assert columns.find_column(["Tumor Seq Allele2"], columns.SYNONYMS["alt"]) == "Tumor Seq Allele2"
    assert columns.find_column(["x"], columns.SYNONYMS["ref"]) is None
    with pytest.raises(columns.ColumnError):
        columns.find_column(["alt_a", "alt_b"], ["alt"])


def test_truth_table(spark, folder):
    (folder / "v.csv").write_text(
        "Chromosome,Start_Position,Reference_Allele,Tumor_Seq_Allele2,seqc2_positive\n"
        "chr1,123.0,a,\"A,T\",1\n1,123,A,A;T,0\n2,5,g,c,1\n"
    )
    got = {r["key"]: r["label"] for r in tables.load_truth(tables.read_table(spark, str(folder / "v.csv"))).collect()}
    assert got == {"1:123:A:A": 0, "2:5:G:C": 1}
    with pytest.raises(columns.ColumnError):
        tables.load_truth(spark.createDataFrame([(1,)], "pos int"))


def test_predictions(spark, folder):
    (folder / "p.csv").write_text("﻿index,label,prob,pred_0.5\n0,1,0.75,1\n1,0,bad,0\n", encoding="utf-8")
    rows = [tuple(r) for r in tables.read_predictions(spark, str(folder / "p.csv")).orderBy("index").collect()]
    assert rows == [(0, 1, 0.75, 1), (1, 0, None, 0)]
    (folder / "q.csv").write_text("label,index,prob,pred_0.5\n1,0,0.5,1\n")
    with pytest.raises(columns.ColumnError):
        tables.read_predictions(spark, str(folder / "q.csv"))
    (folder / "s.tab").write_text("k1\t200\t150\t30\t0.2\n")
    assert tuple(tables.read_signal(spark, str(folder / "s.tab")).first()) == ("k1", 200, 150, 30.0, 0.2)
    (folder / "e.csv").write_text("key,AD,DP,VAF,MQ,SB\nk,x,5,0.1,1,0\n")
    assert tuple(tables.read_evidence(spark, str(folder / "e.csv")).first()) == ("k", 5.0, None, 0.1, 1.0, 0.0)


def test_row_numbers(spark, folder):
    (folder / "n.csv").write_text("v\n" + "\n".join(str(i) for i in range(50)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        numbered = tables.with_row_number(tables.read_table(spark, str(folder / "n.csv")))
        assert numbered.rdd.getNumPartitions() >= 1
        assert all(int(r["v"]) == r["row"] for r in numbered.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", ["30", "134217728"])
def test_fasta(spark, folder, split):
    first, second = "ACGTN" * 13, "TTGCA" * 3
    wrapped = [first[i : i + 7] for i in range(0, len(first), 7)]
    (folder / "r.fa").write_text(">one description\n" + "\n".join(wrapped) + "\n>two\n" + second + "\n>empty\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r["contig"], r["chunk_id"]): r["text"] for r in fasta.read_fasta(spark, str(folder / "r.fa"), 10, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for name, text in (("one", first), ("two", second)):
        for k in range((len(text) + 9) // 10):
            want[(name, k)] = text[k * 10 : k * 10 + 14]
    assert got == want


def test_sinks(spark, folder):
    frame = spark.createDataFrame([("a", 0.123456, None), ("b", 1.0, 2)], "tool string, x double, n int")
    sinks.write_csv(frame.coalesce(1), str(folder / "out"), decimals=4)
    text = "".join(p.read_text() for p in (folder / "out").glob("part-*"))
    assert text == "tool,x,n\na,0.1235,\nb,1.0000,2\n"
    lines = sinks.metric_lines(frame.filter("tool = 'a'"), {"x": "AUROC", "n": "TP"})
    assert [r[0] for r in lines.collect()] == ["AUROC=0.123456", "TP=nan"]
    report = sinks.report_rows(frame, ["x", "n"]).orderBy("tool").collect()
    assert [r["line"] for r in report] == ["a | 0.123 | ", "b | 1.000 | 2.000"]
    windows = spark.createDataFrame([("1", 0, 5, "k")], schemas.WINDOWS)
    sinks.write_bed(windows, str(folder / "bed"))
    assert "".join(p.read_text() for p in (folder / "bed").glob("part-*")) == "1\t0\t5\tk\n"


def test_predictions_roundtrip(spark, folder):
    frame = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.1234567)], "index bigint, label int, prob double")
    sinks.write_predictions(frame, str(folder / "p"))
    back = tables.read_predictions(spark, str(folder / "p")).orderBy("index").collect()
    assert [tuple(r) for r in back] == [(0, 1, 0.5, 1), (1, 0, 0.123457, 0)]


def test_feature_store(spark, folder):
    frame = spark.createDataFrame([("a", [0.5], 1), ("b", [0.1], 0)], "key string, qc array<float>, y int")
    tables.write_features(frame, str(folder / "f"))
    kept = tables.read_features(spark, str(folder / "f"), 1)
    assert [r["key"] for r in kept.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(y" in kept._jdf.queryExecution().executedPlan().toString()


def test_keys_of_sources_match(spark):
    frame = spark.createDataFrame([("chr1", "5.0", "a", "c,t")], "chrom string, pos string, ref string, alt string")
    assert frame.select(variant_key()).first()[0] == "1:5:A:C"
    assert frame.select(variant_key(normalise=False)).first()[0] == "chr1:5.0:a:c,t"
    assert frame.select(F.lit(1)).count() == 1

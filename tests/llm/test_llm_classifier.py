from conftest import ODD_TEXTS, SF

from callscope.llm import quality_classifier as qc


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    judged = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    assert len(judged) == docs.count()
    # Fitted on ids of even hash, judged on the rest.
    half = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    held = {r.doc_id: r for r in qc.classify(docs, half).collect()}
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    assert sum(held[r.doc_id].kept == bool(r.quality) for r in rest) / len(rest) > 0.95
    kept = {r.doc_id for r in qc.accepted(docs, labels).collect()}
    assert kept == {i for i, r in judged.items() if r.kept}


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 500 + [("bad", "p", 0.1)] * 500 + [("new", "p", 0.05), ("bad", "q", 0.95)]
    sites = {(r.site_host, r.site_path): r for r in qc.site_shares(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert abs(sites["big", "p"].host_share - 0.9) < 0.05 and abs(sites["bad", "p"].host_share - 0.1) < 0.05
    new, fresh = sites["new", "p"], sites["bad", "q"]
    assert 0.05 < new.host_share < mean  # one document moves a site only part of the way
    assert abs(fresh.path_share - fresh.host_share) < abs(0.95 - fresh.host_share)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 0), (4, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for use in (labels, labels.limit(0)):
        assert qc.classify(odd, use).count() == len(ODD_TEXTS)
        assert qc.classify(odd, use).where("kept IS NULL OR score IS NULL").count() == 0
        out = qc.accepted(odd, use)
        assert out.schema.names == odd.schema.names
    assert qc.accepted(odd, labels.limit(0)).count() == len(ODD_TEXTS)
    assert qc.classify(odd.limit(0), labels).count() == 0
    assert qc.classify(spark.read.parquet(f"{SF}/documents.parquet").drop("lang", "source"), labels).count() > 0

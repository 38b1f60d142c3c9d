import os
import sys

import public_tokenizers
from conftest import SF
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from brute_texts import contamination, sha  # noqa: E402
from test_llm_near_copies import brute_groups  # noqa: E402
from test_llm_secrets import brute as secrets  # noqa: E402

from callscope.llm import queries, quality_classifier  # noqa: E402


def test_run_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    first = brute_groups([t for _, t in rows])
    rows = {i: t for k, (i, t) in enumerate(rows) if k == first[k]}
    items = [(r.item_id, r.text) for r in bench.collect()]
    hits = {i: contamination(t, items) for i, t in rows.items()}
    dirty = {i for i, (n, hit, _) in hits.items() if hit and 20 * hit >= n}
    gone = {i for i in dirty if 2 * hits[i][1] >= hits[i][0]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows) - gone
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in rows.items():
        if i in dirty or i in gone:
            continue
        if not secrets(text) and not queries.secret_scan.find(text)[1]:
            ids = library.encode(text, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)))) and got[i].ids == ids


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if number == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for r in docs.collect():
                n, hit, _ = contamination(r.text, items)
                assert not (hit and 20 * hit >= n)
        if number == 3:
            assert not any(secrets(r.text) for r in docs.collect())
        if number < 4:
            assert docs.columns == names
    assert len(corpus_pipeline.STAGES) == 5


def test_queries_with_sql(spark):
    connection, sql = check_oracle.duck(SF), queries.oracle_sql()
    for name, text in sql.items():
        assert check_oracle.compare(spark, connection, name, queries.queries()[name], text, SF) is None
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 14)]

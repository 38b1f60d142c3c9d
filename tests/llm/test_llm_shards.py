import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD_TEXTS

from callscope.llm import token_shards as ts

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65, 1000, 4096, 5000])
def test_feistel_is_a_bijection(n):
    assert sorted(ts.permuted(n, ts.round_keys(7, 1)).tolist()) == list(range(n))
    if n >= 1000:
        assert not np.array_equal(ts.permuted(n, ts.round_keys(7, 1)), ts.permuted(n, ts.round_keys(8, 1)))


def expected(rows, size):
    encode, out = ts.tokenizer(*FILE).encode_ordinary, Counter()
    for doc_id, text in rows:
        ids = [*encode(text or ""), ts.END]
        for part in range(0, len(ids), size):
            data = np.array(ids[part : part + size], "<u2").tobytes()
            out[doc_id, part // size, len(data) // 2, hashlib.sha256(data).hexdigest()] += 1
    return out


def test_every_sequence_has_one_slot(spark, odd, documents):
    for frame, size in ((documents, 512), (odd, 64)):
        index = ts.materialise(frame, *FILE, size=size).collect()
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        assert Counter((r.doc_id, r.part, r.n_tokens, r.tokens_sha256) for r in index) == expected(rows, size)
        assert sorted(r.slot for r in index) == list(range(len(index)))
        by_slot = sorted(index, key=lambda r: r.slot)
        assert [(r.shard, r.place) for r in by_slot] == sorted((r.shard, r.place) for r in index)
    assert ts.materialise(odd.limit(0), *FILE).count() == 0


def test_order_depends_on_key_alone(spark, documents):
    order = lambda frame, key: [(r.doc_id, r.part) for r in sorted(ts.materialise(frame, *FILE, key=key).collect(), key=lambda r: r.slot)]
    first = order(documents, 1)
    assert order(documents.repartition(7, "text"), 1) == first != order(documents, 2)
    place = {x: k for k, x in enumerate(first)}
    steps = [abs(place[d, p] - place[d, p + 1]) for d, p in first if (d, p + 1) in place]
    assert np.mean(steps) > len(first) / 6  # parts of a document lie far apart


def test_reading_resumes_at_a_place(tmp_path, spark, documents):
    folder = f"file:{tmp_path}/out"
    ts.write_shards(documents, folder, *FILE, size=32)
    file = max(tmp_path.glob("out/shard=*/part-*"), key=lambda p: p.stat().st_size)
    data = file.read_bytes()
    stride = ts.HEADER + 2 * 32 + 1
    assert len(data) % stride == 0
    whole = list(ts.read_records(data, 32))
    assert list(ts.read_records(data, 32, start=5)) == whole[5:]
    assert len(ODD_TEXTS) and all(len(ids) % 2 == 0 for _, _, ids in whole)


def test_equal_rows_and_empty_texts_spread_evenly(spark, monkeypatch):
    monkeypatch.setattr(ts, "SHARD_BYTES", 1 << 20)
    rows = [(7, "one two three")] * 6000 + [(None, None)] * 6000 + [(k + 100, "") for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = ts.materialise(frame, *FILE, size=64)
    sizes = sorted(r["count"] for r in index.groupBy("shard").count().collect())
    assert len(sizes) == ts.LEAST_SHARDS and sizes[-1] < 1.5 * 18_000 / ts.LEAST_SHARDS
    assert index.groupBy("doc_id").count().where("count = 6000").count() == 2
    assert index.select("slot").distinct().count() == 18_000
    more = ts.materialise(frame, *FILE, size=4096)
    assert more.select("shard").distinct().count() > 2 * ts.LEAST_SHARDS  # records count, not bytes of text


def test_order_of_repeated_rows_does_not_depend_on_layout(spark):
    rows = [(k % 7, f"text {k % 5}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda f: [(r.doc_id, r.tokens_sha256) for r in sorted(ts.materialise(f, *FILE).collect(), key=lambda r: r.slot)]
    assert order(frame.repartition(3)) == order(frame.repartition(8, "text"))


def test_texts_stay_where_they_are_to_be_told_apart(spark):
    rows = spark.createDataFrame([(k % 7, f"text {k % 9}") for k in range(100)], "doc_id long, text string")
    found = ts.told_apart(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = [tuple(r) for r in found.select("doc_id", "text", "copy").collect()]
    assert len(got) == len(set(got)) == 100 and max(r[2] for r in got) == 1

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from callscope.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, top):
    """Sorted (item_id, rank, doc_id, score)."""
    counted = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    counted = [(doc_id, c, c.total()) for doc_id, c in counted if c]
    size, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, asked in {(i, frozenset(words(text))) for i, text in items}:
        found = []
        for doc_id, c, n in counted:
            m = 100 - 50 + (50 * n * size) // total
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort(key=lambda x: x[:3])
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, _, doc_id) in enumerate(found[:top])]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def drawn(seed, n, vocabulary=60, longest=60):
    draw = random.Random(seed)
    known = [f"w{k}" for k in range(vocabulary)] + ["Été", "日本", "É", "x9"]
    odds = [1 / (k + 1) for k in range(len(known))]
    make = lambda most: draw.choice((" ", ", ", "-")).join(draw.choices(known, odds, k=draw.randint(1, most)))
    docs = [(k, make(longest)) for k in range(n)]
    items = [(k, make(12)) for k in range(15)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 50)
    monkeypatch.setattr(search, "BLOCK", 4)
    docs, items = drawn(1, 900)
    docs += [(None, docs[3][1]), (None, None), (5, docs[5][1]), (901, ""), (902, "?!"), (903, "w1 " * 4000)]
    docs += [(1000 + k, docs[7][1]) for k in range(80)]  # ties beyond the top
    items += [(None, "w1 w50"), (3, "other w2"), (3, items[3][1]), (20, None), (21, "."), (22, "nowhere"), (23, docs[7][1])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", term string, shard int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS + ", rank int")
    got = search.search(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute(docs, items, 50)


@pytest.mark.parametrize("terms", [1, 40])
def test_items_in_groups(spark, monkeypatch, terms):
    monkeypatch.setattr(search, "ITEM_TERMS", terms)
    monkeypatch.setattr(search, "MAP_BITS", 64)  # most terms pass such a map
    docs, items = drawn(2, 200)
    got = search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 7)
    assert found(got) == brute(docs, items, 7)


def test_real_table(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert found(search.search(documents, benchmark)) == brute(docs, items, 50)


def test_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "same word five 日本語"), (2, "")]
    assert found(search.search(odd, spark.createDataFrame(items, ITEMS))) == brute(docs, items, 50)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], DOCS)
    items, no_items = spark.createDataFrame([(1, "a")], ITEMS), spark.createDataFrame([], ITEMS)
    assert search.search(none, items).collect() == []
    assert search.search(some, no_items).collect() == []
    assert search.search(none, no_items).collect() == []


def test_variable_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 5, 2**40], np.int64)
    raw, sizes = search.vbytes(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 1, 6]
    assert search.from_vbytes(raw.tobytes()).tolist() == values.tolist()


def test_frontier():
    draw = random.Random(4)
    for _ in range(200):
        pairs = [(draw.randint(1, 6), draw.randint(1, 20)) for _ in range(draw.randint(1, 12))]
        tf, length = search.frontier(*(np.array(x) for x in zip(*pairs, strict=True)))
        kept = set(zip(tf.tolist(), length.tolist(), strict=True))
        best = {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
        assert kept == best


def test_blocks_are_rejected_before_decompression():
    """With a threshold from earlier shards, most blocks of the frequent term stay compressed."""
    scorer = search.Scorer(100_000, 10_000_000)
    m = scorer.lengths(np.full(10_000, 100, np.int64))
    rare, common = search.List(9000, scorer, m), search.List(300, scorer, m)

    def fill(own, docs):
        for at in range(0, len(docs), search.BLOCK):
            part = np.array(docs[at : at + search.BLOCK])
            gaps = np.diff(part, prepend=0)
            both = np.column_stack([gaps, np.ones(len(part), np.int64)]).ravel()
            one = np.ones(1, np.int64)
            own.add(int(part[0]), int(part[-1]), one.tobytes(), (100 * one).tobytes(), search.vbytes(both)[0].tobytes())
        own.close()

    fill(rare, [5, 6000])
    fill(common, list(range(0, 10_000, 2)))
    odd_only = search.List(9000, scorer, m)
    fill(odd_only, [20_001 % 10_000])  # its document lies behind the last one of no block that has it
    far = search.List(300, scorer, m)
    fill(far, [9000, 9002])
    assert search.best_of([far, odd_only], odd_only.bound, 10_000, 1)[0].tolist() == [1]
    docs, _ = search.best_of([common, rare], rare.bound, 10_000, 1)
    assert 6000 in docs.tolist()
    assert len(common.made) <= 2 < len(common.data)

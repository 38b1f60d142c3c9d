import numpy as np
import xxhash
from brute_texts import components
from conftest import ODD_TEXTS

from callscope.llm import simhash
from callscope.llm.components import stars


def brute_print(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_documents_and_odd_rows(spark, odd, documents):
    for frame in (odd, documents):
        rows = frame.select("doc_id", "text").collect()
        prints = [brute_print(r.text) for r in rows]
        want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, components([r.doc_id for r in rows], prints))]
        assert sorted(map(tuple, simhash.simhash(frame).collect()), key=str) == sorted(want, key=str)
    assert simhash.simhash(odd.limit(0)).count() == 0


def test_dense_fingerprints(spark):
    draw, values = np.random.default_rng(3), []
    for centre in draw.integers(0, 1 << 64, 12, np.uint64):
        for _ in range(50):
            value = int(centre)
            for bit in draw.integers(0, 64, draw.integers(0, 7)):
                value ^= 1 << int(bit)
            values.append(value)
    values += list(range(1500)) + [5, 5, (1 << 64) - 1, 1 << 63]
    frame = spark.createDataFrame(
        [(k, int(np.uint64(v).astype(np.int64)), 0) for k, v in enumerate(values)], "doc_id long, fp long, tie long"
    )
    got = dict(simhash.grouped(frame).select("doc_id", "component_id").collect())
    assert [got[k] for k in range(len(values))] == components(range(len(values)), values)


def test_links_span_without_listing_pairs(spark):
    frame = spark.createDataFrame([(int(v),) for v in range(2000)], "fp long")
    assert simhash.links(frame).count() < 28 * 2000


def test_gray_order():
    codes = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    ranks = simhash.gray_ranks(codes)
    assert np.array_equal(ranks ^ (ranks >> np.uint64(1)), codes)
    for order in simhash.ORDERS[::9]:
        assert np.array_equal(simhash.restored(simhash.arranged(codes, order), order), codes)


def test_one_of_each(odd, documents):
    rows = simhash.simhash(documents).collect()
    kept = sorted(r.doc_id for r in simhash.one_of_each(documents).collect())
    assert kept == sorted({r.component_id for r in rows})
    twice = simhash.one_of_each(documents.union(documents))
    assert sorted(r.doc_id for r in twice.collect()) == kept
    out = simhash.one_of_each(odd)
    assert out.schema.names == odd.schema.names
    groups = {(r.component_id, r.fingerprint if r.component_id is None else "") for r in simhash.simhash(odd).collect()}
    assert out.count() == len(groups) < len(ODD_TEXTS)
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_stars_on_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(10, 200)] + [(1000, k) for k in range(1001, 1500)] + [(5, 5), (300, 301), (301, 300)]
    got = dict(stars(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {k: 10 for k in range(11, 201)} | {k: 1000 for k in range(1001, 1500)} | {301: 300}
    assert got == want

import random

import numpy as np
import pytest
from conftest import ODD_TEXTS

from callscope.llm import near_copies as nc


def brute_groups(texts, least=0.8):
    """The smallest index that each text reaches over pairs of similar shingle sets."""
    words = [nc.words_of(t or "") for t in texts]
    sets = [nc.shingles(w) for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def prose(draw, n):
    return [f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{draw.choice('lmnrst')}{draw.randint(0, 40)}" for _ in range(n)]


def edited(draw, words, share):
    """Words with some replaced, so that about ``share`` of the shingles stay alike."""
    out, changes = list(words), max(1, round(len(words) * (1 - 2 * share / (1 + share)) / 5))
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"new{draw.randint(0, 10**6)}"
    return out


def test_similarity_and_fingerprint():
    a = "one two three four five six".split()
    enc = lambda x: [w.encode() for w in x]
    assert nc.similarity(enc(a), enc(a[:5])) == 0.5
    assert nc.similarity(enc(["x"]), enc(["x"])) == 1.0 and nc.similarity([], []) == 1.0 and nc.similarity(enc(["x"]), []) == 0.0
    assert nc.words_of("A\tb\xa0É\x0bc") == [b"a", "b\xa0É".encode(), b"c"]
    assert nc.fingerprint([]) == bytes(16)
    many = enc([f"w{k}" for k in range(70_000)])
    bits = np.zeros(128, int)
    for w in many:
        bits += np.unpackbits(np.frombuffer(nc.xxhash.xxh3_128_digest(w), np.uint8))
    assert nc.fingerprint(many + many[:9]) == np.packbits(2 * bits > len(many)).tobytes()


def test_recall_against_all_pairs(spark):
    """Nearly all pairs from 0.8 on are found, and nothing below 0.8 is."""
    draw = random.Random(11)
    texts = [" ".join(prose(draw, draw.randint(30, 400))) for _ in range(260)]
    wanted = []
    for k in range(240):
        words = texts[k].split()
        other = edited(draw, words, draw.uniform(0.78, 0.97))
        alike = nc.similarity([w.encode() for w in words], [w.encode() for w in other])
        wanted.append((k, len(texts), alike))
        texts.append(" ".join(other))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.group for r in nc.groups(frame).collect()}
    near = [(a, b) for a, b, s in wanted if s >= 0.8]
    low = [(a, b) for a, b, s in wanted if 0.8 <= s < 0.9]
    assert len(low) > 40
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    assert sum(got[a] == got[b] for a, b in low) >= 0.95 * len(low)
    true = brute_groups(texts)
    by = {}
    for k, own in got.items():
        by.setdefault(own, set()).add(true[k])
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("stretch", [4, 2048])
def test_large_families(spark, monkeypatch, stretch):
    """Exact copies, and one family of many near copies, cut into stretches."""
    monkeypatch.setattr(nc, "STRETCH", stretch)
    draw = random.Random(3)
    base = prose(draw, 300)
    texts = [" ".join(base)] * 60 + [" ".join(edited(draw, base, 0.97)) for _ in range(200)]
    texts += [" ".join(prose(draw, 80)) for _ in range(50)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    out = {r.doc_id for r in nc.one_of_each(frame).collect()}
    true = brute_groups(texts)
    assert out == set(true)


def test_odd_rows(spark, odd):
    kept = nc.one_of_each(odd)
    assert kept.schema.names == odd.schema.names
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    true = brute_groups([t for _, t, *_ in ODD_TEXTS])
    assert len(got) == len(set(true))
    assert nc.one_of_each(odd.limit(0)).count() == 0


def test_reordered_and_shared_words_are_no_copies(spark):
    draw = random.Random(5)
    words = prose(draw, 200)
    mixed = words[:]
    draw.shuffle(mixed)
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(mixed)), (3, " ".join(words).upper())], "doc_id long, text string")
    assert sorted(r.doc_id for r in nc.one_of_each(frame).collect()) == [1, 2]


def same_groups(frame, texts):
    """Whether ``groups`` puts rows together as all pairs of texts do."""
    got, true = {r.doc_id: r.group for r in nc.groups(frame).collect()}, brute_groups(texts)
    return len(set(zip(true, (got[k] for k in range(len(texts)))))) == len(set(true)) == len(set(got.values()))


def test_pairs_that_the_index_misses(spark):
    """Four of five shingles in common, but fingerprints of few words are far apart."""
    draw = random.Random(21)
    texts = []
    for _ in range(150):
        words = prose(draw, 9)
        texts += [" ".join(words), " ".join(words[:8])]
    prints = [np.frombuffer(nc.fingerprint(nc.words_of(t)), np.uint8) for t in texts]
    far = sum(np.bitwise_count(a ^ b).sum() > nc.DISTANCE for a, b in zip(prints[::2], prints[1::2], strict=True))
    assert far > 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert same_groups(frame, texts)
    assert sorted(r.doc_id for r in nc.one_of_each(frame).collect()) == list(range(0, 300, 2))


@pytest.mark.parametrize(("meeting", "share"), [(1024, 16), (2, 1)])
def test_exact_way_without_the_index(spark, monkeypatch, meeting, share):
    """Families, texts made of a common line, short and empty ones: all pairs are found by shingles alone."""
    monkeypatch.setattr(nc, "MEETING", meeting)
    monkeypatch.setattr(nc, "ORDER_SHARE", share)
    monkeypatch.setattr(nc, "candidates", lambda nodes: nodes.select(*[nodes.node.alias(x) for x in "ab"]).limit(0))
    draw = random.Random(22)
    base, line = prose(draw, 200), prose(draw, 25)
    texts = [" ".join(edited(draw, base, draw.uniform(0.75, 0.95))) for _ in range(60)]
    texts += [" ".join(line + prose(draw, draw.randint(0, 12))) for _ in range(60)]
    texts += [" ".join(prose(draw, draw.randint(0, 7))) for _ in range(40)] + ["ha " * k for k in range(1, 30)]
    for k in range(40):
        texts.append(" ".join(edited(draw, texts[k].split(), 0.85)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert same_groups(frame, texts)


@pytest.mark.parametrize(("crowd", "words"), [(2, 8), (40, 1)])
def test_exact_way_in_crowds(spark, monkeypatch, crowd, words):
    """Where many texts meet, all their shingles are counted; pairs met in and beside crowds are all found."""
    monkeypatch.setattr(nc, "CROWD", crowd)
    monkeypatch.setattr(nc, "WORDS", words)
    monkeypatch.setattr(nc, "MEETING", 16)
    monkeypatch.setattr(nc, "candidates", lambda nodes: nodes.select(*[nodes.node.alias(x) for x in "ab"]).limit(0))
    draw = random.Random(23)
    texts, line = [], prose(draw, 12)
    for size in (30, 90, 250):
        base = prose(draw, size)
        for _ in range(60):
            own = edited(draw, base, draw.uniform(0.7, 0.95))[: draw.randint(size - size // 6, size)]
            texts.append(" ".join(own + line[: draw.choice((0, 0, 6, 12))]))
    texts += [" ".join(prose(draw, draw.randint(0, 9))) for _ in range(30)] + ["ha " * k for k in range(1, 20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert same_groups(frame, texts)


def test_a_family_just_below_the_limit_is_not_paired(spark):
    """Texts about 0.76 alike meet in many shingles; few of their pairs are left to check, and no similar one is lost."""
    draw = random.Random(24)
    base, texts = prose(draw, 150), []
    for k in range(300):
        words = list(base)
        for at in draw.sample(range(5, 145), 2):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    described = nc.described(frame.withColumnRenamed("node", "doc_id")).withColumnRenamed("doc_id", "node")
    none = frame.selectExpr("node", "node as root").limit(0)
    found = {(r.a, r.b) for r in nc.missed(described, none, nc.SHINGLE, nc.SIMILARITY).collect()}
    sets = [nc.shingles(nc.words_of(t)) for t in texts]
    similar = {(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 0 < len(similar) < 10_000 and similar <= found
    assert len(found) < 1.5 * len(similar) + 100


def test_first_shingles_hold_one_of_every_similar_text():
    assert [nc.prefix_size(n) for n in (1, 4, 5, 9, 10, 100)] == [1, 1, 2, 2, 3, 21]
    assert nc.prefix_size(10, 0.3) == 8 and nc.prefix_size(3, 1.0) == 1
    words = [w.encode() for w in "a b c d e f a b c d e".split()]
    assert len(nc.shingle_hashes(words)) == len(nc.shingles(words)) == 6
    assert len({nc.shingle_hashes(words[:k]).tobytes() for k in range(5)}) == 5

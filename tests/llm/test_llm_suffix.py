import random
from collections import Counter

import numpy as np
import pytest
from brute_texts import removed_bytes
from conftest import ODD_TEXTS

from callscope.llm import suffix_dedup, suffix_runs


def test_loser_tree_merges_runs():
    draw = random.Random(4)
    for _ in range(300):
        runs = [
            {bytes(draw.choices(b"ab", k=6)): draw.randint(1, 3) for _ in range(draw.randint(0, 20))}
            for _ in range(draw.randint(0, 9))
        ]
        want = Counter()
        for run in runs:
            want.update(run)
        assert list(suffix_runs.merged(map(suffix_runs.front_coded, runs), 6)) == sorted(want.items())


def test_leftmost_least():
    draw = np.random.default_rng(4)
    for _ in range(200):
        values, width = draw.integers(0, 5, draw.integers(7, 60)).astype(np.uint64), 7
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert suffix_dedup.leftmost_least(values, width).tolist() == want


def check(spark, rows, columns="doc_id long, text string"):
    got = suffix_dedup.dedup(spark.createDataFrame(rows, columns)).collect()
    want = [(row[0], *out) for row, out in zip(rows, removed_bytes([row[1] for row in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeéü", k=draw.randint(1, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    passage, exact = prose(90), prose(70).encode()[:400].decode(errors="ignore")
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "y" * 3000, "ab" * 1500, "z" * 400, "z" * 399]
    for _ in range(60):
        kind, text = draw.random(), prose(draw.randint(20, 300))
        if kind < 0.3:  # a passage of which a random part is shared
            text = text[: draw.randint(0, len(text))] + passage[draw.randint(0, 100) :] + prose(30)
        elif kind < 0.5:  # strings of just the length, or one less
            text = prose(10) + exact[draw.randint(0, 1) :] + prose(10)
        elif kind < 0.7:  # near copies
            text = draw.choice([t for t in texts if t and len(t) > 300]).split(" ")
            for _ in range(draw.randint(0, 6)):
                text[draw.randrange(len(text))] = draw.choice(words)
            text = " ".join(text)
        elif kind < 0.78:  # a period inside a document
            text = (prose(12) + "\n") * 30
        texts.append(text)
    check(spark, [*enumerate(texts), (20, texts[20]), (None, texts[30])])


def test_parts_of_a_long_text(spark, monkeypatch):
    draw = random.Random(9)
    text = "".join(draw.choices("abcdefgh ", k=5000))
    whole = suffix_dedup.anchors(text.encode())
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    parts = suffix_dedup.anchors(text.encode())
    cover = lambda found: [(s + k, s + i, int(h)) for h, _, s, n, i in zip(*found) for k in range(n)]
    assert cover(whole) == cover(parts)


def test_hot_passage_and_odd_rows(spark, odd):
    draw = random.Random(6)
    noise = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    passage = noise(450)
    check(spark, [(k, noise(draw.randint(0, 300)) + passage + noise(draw.randint(0, 300))) for k in range(300)])
    short = [row for row in ODD_TEXTS if len(row[1] or "") < 5000]
    check(spark, [(r[0], r[1], "a", 1) for r in short], "doc_id long, text string, rid string, h int")
    assert suffix_dedup.dedup(odd).count() == len(ODD_TEXTS)
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0

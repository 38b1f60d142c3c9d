import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from callscope.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def merged(model, text):
    """The parts after all merges, best score and leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        costs = [model.cost.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
        if min(costs) == float("inf"):
            break
        i = costs.index(min(costs))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def texts(model, n):
    draw = random.Random(4)
    known = list(model.number)
    odd = ["  ", " ", "a", "\n", "Ａ", "é", "▁", "😀", "́", "th", "ing", ",", ".", "\x00", "<s>", "<0x0A>", "½"]
    for k in range(n):
        if k % 4 == 0:
            yield "".join(draw.choices(known, k=draw.randint(1, 6))).replace("▁", " ")
        elif k % 4 == 1:
            yield "".join(draw.choices("abcdeinorst .,", k=draw.randint(0, 40)))
        elif k % 4 == 2:
            yield "".join(draw.choices(odd, k=draw.randint(0, 30)))
        else:
            yield " " * draw.randint(0, 50) + "".join(draw.choices(known, k=3)) + " " * draw.randint(0, 70)


def test_against_library(model, library):
    for text in texts(model, 12_000):
        ids = library.encode(text)
        assert model.ids(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_table_against_merging(model):
    draw = random.Random(9)
    for _ in range(1500):
        unit = "▁" * draw.randint(0, 40) + "".join(draw.choices("aehinrstüß.😀", k=draw.randint(0, 25)))
        assert model.tokens(unit) == merged(model, unit) if unit else True


def test_neighbours_against_merging(model):
    draw = random.Random(2)
    tokens = list(model.right)
    for _ in range(20_000):
        a, b = draw.choice(tokens), draw.choice(tokens)
        assert model.fits(a, b) == (merged(model, a + b) == [a, b]), (a, b)


def test_any_ids_decode_as_in_library(model, library):
    draw = random.Random(3)
    for _ in range(4000):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(259, 32_000), 0, 1, 2]) for _ in range(draw.randint(0, 6))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_units(model, library):
    for text in ("ab" * 50_000, " " * 50_001, "日本語" * 20_000, "\n" * 30_000):
        assert model.ids(text) == library.encode(text)


def rows_of(library, rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc_id, text in rows:
        ids = library.encode(text or "")
        yield doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_odd_rows(odd, library):
    got = sorted((tuple(r) for r in pieces.encode(odd, MODEL).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got == sorted(rows_of(library, rows), key=str)


def test_documents(documents, library):
    got = sorted(tuple(r) for r in pieces.encode(documents, MODEL).collect())
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got == sorted(rows_of(library, rows))


def test_round_trip_through_tables(spark, documents):
    encoded = pieces.encode(documents, MODEL, with_ids=True)
    back = pieces.decode(encoded, MODEL).withColumnRenamed("text", "decoded")
    both = documents.join(back, "doc_id")
    assert both.count() == documents.count()
    assert both.where("coalesce(text, '') != decoded").count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(none, MODEL).collect())) == [(1, None), (2, "")]


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []

from zlib import crc32

from conftest import ODD_TEXTS

from callscope.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    some = {lang: " ".join(r.text[:1500] for r in docs.where(f"lang = '{lang}'").limit(3).collect()) for lang in ("en", "fr")}
    names, shares = model.predict([some["en"] + " " + some["fr"][: len(some["en"]) // 2], some["en"], some["fr"]])
    assert names == ["en", "en", "fr"]
    assert 0.5 < shares[0] < 0.85 and shares[1] > 0.9 and shares[2] > 0.9


def test_counts_and_pieces(spark, monkeypatch):
    texts = ["the and of " * 50, "été là où", "x"]
    model = language.Model([("a", 5, 3), ("b", 9, 1)])
    whole = model.words(texts)
    monkeypatch.setattr(language, "PIECE", 40)
    cut = model.words(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    rows = language.count_grams(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")).collect()
    assert sum(r.n for r in rows) == sum(map(str.isalpha, "".join(texts)))


def test_odd_rows(spark, odd):
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        assert (r.lang_pred == "und") == (r.score == 0)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2))
    assert language.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.Model([])).collect()} == {"und"}

import random

import duckdb
import pytest
from brute_texts import contamination, sha
from conftest import ODD_TEXTS

from callscope.llm import decontaminate as dc
from callscope.llm import queries


@pytest.mark.parametrize("most", [30, 10_000])
def test_against_brute_force(spark, most):
    draw = random.Random(8)
    words = "a b c É ü 1 the x".split()
    prose = lambda n: draw.choice((" ", ", ", "\n")).join(draw.choices(words, k=n))
    items = [(k if k != 3 else None, prose(draw.choice((0, 1, 4, 12, 13, 14, 30)))) for k in range(12)]
    items += [(20, None), (21, "?!"), (22, items[4][1]), (22, items[5][1])]
    texts = [None, "", "?"] + [prose(draw.randint(1, 60)) for _ in range(60)]
    texts += [prose(9) + " " + (items[k][1] or "").upper() + " " + prose(9) for k in range(12)]
    rows = [*enumerate(texts), (None, texts[9]), (5, texts[5])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.contamination(frame, bench, most).collect()), key=str)
    want = []
    for doc_id, text in rows:
        n, hit, names = contamination(text, items)
        known = [x for x in names if x != "None"]
        want.append((doc_id, n, hit, len(names), sha(",".join(known)), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=str)


def test_removal(spark):
    words = [f"w{k}x" for k in range(200)]
    item = " ".join(words[:20])
    clean, rest = " ".join(words[100:160]), " ".join(words[170:190])
    rows = [
        (1, clean, 0),
        (2, f"{clean} {item.upper()} {rest}", 0),
        (3, item, 0),
        (4, " ".join(words[30:190] * 3) + " " + " ".join(words[:13]), 0),
        (5, None, 7),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in dc.decontaminate(frame, bench).collect()}
    assert set(out) == {1, 2, 4, 5} and out[1].text == clean and out[4].text == rows[3][1]
    assert out[2].text == f"{clean} {rest}" and out[2].n_chars == len(out[2].text)
    assert out[5].text is None and out[5].n_chars == 7 and out[1].n_chars == 0


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    for use in (bench, bench.limit(0)):
        assert dc.contamination(odd, use).count() == len(ODD_TEXTS)
        assert dc.decontaminate(odd, use).schema.names == odd.schema.names
    assert dc.contamination(odd.limit(0), bench).count() == 0
    assert dc.decontaminate(odd, bench).count() == len(ODD_TEXTS) - 1


def test_items_without_an_id_count_as_in_the_sql(spark, tmp_path):
    words = [f"w{k}x" for k in range(60)]
    long, other, short = " ".join(words[:20]), " ".join(words[30:45]), "one two"
    bench = [(None, long), (7, other), (None, short), (8, short), (None, None), (None, "?!")]
    rest = " ".join(words[45:]) * 4
    texts = [f"{rest} {long}", f"{other} {rest}", "a one two b", f"{long} {other} one two", rest, None]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    for name in ("benchmark", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = connection.execute(queries.OP10).fetchall()
    for most in (15, 10_000):
        tables = [spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark")]
        got = {tuple(r) for r in dc.contamination(*tables, most).collect()}
        assert got == set(want) and {(r[0], r[3]) for r in got} == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 0), (5, 0)}
    docs, items = tables
    out = {r.doc_id: r.text for r in dc.decontaminate(docs, items).collect()}
    assert long not in (out.get(0) or "") and out[4] == rest


def test_signs_and_words_behind_a_passage_stay(spark):
    words = [f"w{k}x" for k in range(20)]
    item, rest = " ".join(words), " ".join(f"r{k}" for k in range(60))
    frame = spark.createDataFrame([(1, f"{rest} {item} 🎉 (gamma) ![x] end"), (2, f"{rest} {item} \t\n next")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in dc.decontaminate(frame, bench).collect()}
    assert out == {1: f"{rest} 🎉 (gamma) ![x] end", 2: f"{rest} \n next"}


def test_growing_benchmark(spark, monkeypatch):
    """Blocks stay bounded as items grow, one by one and in number, and give what one block gives."""
    draw = random.Random(4)
    items = [(k, " ".join(f"t{draw.randint(0, 400)}" for _ in range(draw.choice((5, 20, 2000))))) for k in range(60)]
    items += [(7, items[7][1])] * 500  # one item many times is one item
    texts = [" ".join(f"t{draw.randint(0, 400)}" for _ in range(30)) for _ in range(40)]
    texts = [f"{t} {' '.join(items[k % 60][1].split()[: 10 + k % 20])} {t}" for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    many, pieces = dc.blocks(bench, 3000)
    sizes = [r["n"] for r in pieces.selectExpr("block", "size(words) AS n").groupBy("block").sum("n").toDF("block", "n").collect()]
    assert many > 10 and max(sizes) <= 6000
    bag = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    assert bag(dc.contamination(frame, bench, 3000)) == bag(dc.contamination(frame, bench))
    whole = bag(dc.decontaminate(frame, bench))
    monkeypatch.setattr(dc.blocks, "__defaults__", (3000,))
    assert bag(dc.decontaminate(frame, bench)) == whole and len(whole) < len(texts) + 1

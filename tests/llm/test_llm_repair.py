import random

import brute_repair as brute
import pytest
from brute_repair import every_repair, least_repair

from callscope.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def drawn(draw, n):
    return [(draw.choice("sua?"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(n)]


def letters(rows):
    return "".join(repair.code(x, "blank" if go else "truncated" if cut else "") for x, go, cut in rows)


def test_plain_version_finds_the_least_of_all_edit_sequences():
    draw = random.Random(1)
    for _ in range(40):
        rows = drawn(draw, draw.randint(0, 3))
        assert least_repair(rows) == every_repair(rows, 3)


@pytest.mark.parametrize("step", [1, 3, 4096])
def test_agenda_against_plain_version(step):
    draw = random.Random(step)
    for _ in range(400):
        rows = drawn(draw, draw.randint(0, 14))
        assert repair.lightest(letters(rows), step) == least_repair(rows)


def test_long_conversation_in_steps():
    rows = drawn(random.Random(3), 3000)
    assert repair.lightest(letters(rows), 256) == repair.lightest(letters(rows), 5000)


def conversations(draw, n):
    texts = ["Yes.", "No", "What?", "", " \t", None, "Fine! ", "a" * 5000 + ".", "é…", "x.\x0b"]
    out = []
    for conv in range(n):
        for turn in range(draw.randint(1, 12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "unknown", "tool"])
            out.append((conv if conv else None, None if draw.random() < 0.05 else turn + (turn > 4) * 3, role, draw.choice(texts)))
    return out + [(7, 2, "user", "Yes."), (7, 2, "user", "Yes."), (7, -3000, "system", "s."), (-5, None, None, None)]


def result(frame):
    return {row[0]: tuple(row) for row in frame.collect()}


def test_against_brute_force(spark):
    rows = conversations(random.Random(5), 80)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", audit int, letters string")
    got = repair.damage_and_repair(frame)
    assert got.columns == [*(name for name, _ in repair.AUDITS), "repaired_sha256"]
    assert result(got) == brute.repair(rows)


def test_conversation_over_many_blocks_and_partitions(spark):
    draw = random.Random(6)
    rows = [(1, k * 3, draw.choice(["user", "assistant"]), f"{k % 900} {draw.choice('ab')}.") for k in range(4000)]
    rows += [(2, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(40)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(repair.damage_and_repair(frame)) == brute.repair(rows)


def test_real_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert result(repair.damage_and_repair(frame)) == brute.repair(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "user", "")]
    audits, out = repair.repair(repair.plain(spark.createDataFrame(rows, SCHEMA)))
    cost, audit = least_repair([("s", False, False), ("a", False, False), ("u", False, False), ("u", True, False)])
    assert [(r.cost, r.audit) for r in audits.collect()] == [(cost, audit)]
    got = [(r.place, r.role, r.text, r.edit) for r in out.orderBy("place").collect()]
    assert [g[0] for g in got] == list(range(len(got)))
    assert "".join(g[1][0] for g in got) in ("sua", "suaua")


def test_empty_table(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []

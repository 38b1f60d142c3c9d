"""Repair of conversations' structure by lightest derivations.

A conversation is well formed if its roles read ``(s?(ua)+)?`` by initials. Every row is kept, given
another role, or deleted, and empty rows may be inserted; each edit costs something. The least
repair is a lightest derivation: an item (i, q) says that rows i and on can be repaired when the
output before them has left the automaton of the pattern in state q. Its value is (cost, rows
covered, audit). A deduction joins an edit of row i, or an insertion, with the item behind it and
puts the edit's letter before that item's audit. This function is superior in Knuth's sense: the cost
never falls, and where it stays (a row kept as it is) the covered rows grow. So items are popped from
an agenda in the order of their values, each is final when popped, and work ends with the goal item
(0, start). From one item each letter leads to one other item only, hence comparing the letter
compares whole audits, and an item stores one letter.

In Spark: rows are damaged or described by column functions; second sights of a (role, text) are found
by a window keyed by conversation, role and text digest; rows of one block of turns become one
string with a letter per row, and blocks of a conversation are put together. What one task holds of
a conversation is one byte per row and state, as is its audit in the result. Texts are shuffled
once, behind the audit of their conversation, and hashed as they stream by.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, prepare, schema_of

#: Costs of edits, and what a kept row with a cut-off text adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space of the contract, and the signs a text may end with.
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
#: Turns in a block; rows that go through one agenda.
BLOCK_TURNS = 1024
AGENDA_ROWS = 4096

#: States of the pattern: nothing yet, behind s, behind u, behind a pair.
START, SYSTEM, OPEN, AFTER = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): OPEN, (SYSTEM, "u"): OPEN, (AFTER, "u"): OPEN, (OPEN, "a"): AFTER}
WANTED = {START: "u", SYSTEM: "u", AFTER: "u", OPEN: "a"}
ROLE = {"u": "user", "a": "assistant"}
#: What leads into a state: (state before, output's initial).
INTO = {q: [(p, x) for (p, x), to in NEXT.items() if to == q] for q in range(4)}


def code(initial: str, fault: str) -> str:
    """The letter of a row: its role's initial, in capitals where its text is cut off; x for other
    roles, and d where the row has to go."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


def lightest(rows: str, step: int = AGENDA_ROWS) -> tuple[int, str]:
    """(cost, audit) of the least repair of a conversation given by its rows' letters.

    ``step`` rows at a time go through the agenda, from the last ones on. The final values of the
    four items at the left end of a step are the axioms of the next, so that an agenda stays small.
    """
    best = bytearray(4 * (len(rows) + 1))  # the letter a final item begins with
    costs: dict[int, int] = {START: 0, AFTER: 0}
    end = len(rows)
    while True:
        begin = max(0, end - step)
        costs = _finalised(rows, begin, end, costs, best)
        if begin == 0:
            break
        end = begin
    audit, i, q = [], 0, START
    while letter := best[4 * i + q]:
        letter = chr(letter)
        audit.append(letter)
        if letter == "K":
            q = NEXT[q, rows[i].lower()]
        elif letter != "D":
            q = NEXT[q, WANTED[q]]
        i += letter != "I"
    return costs[START], "".join(audit)


def _finalised(rows: str, begin: int, end: int, axioms: dict[int, int], best: bytearray) -> dict[int, int]:
    """Costs of the items at ``begin`` from those at ``end``; fills in the letters of items between."""
    agenda = [(cost, 0, 0, q) for q, cost in axioms.items()]  # (cost, rows covered, letter, state)
    heapq.heapify(agenda)
    final = bytearray(4 * (end - begin + 1))
    push, costs = heapq.heappush, {}
    while agenda:
        cost, covered, letter, q = heapq.heappop(agenda)
        at = 4 * covered + q
        if final[at]:
            continue
        final[at] = 1
        i = end - covered
        if letter:
            best[4 * i + q] = letter
        if i == begin:
            costs[q] = cost
            if q == START and begin == 0 or len(costs) == 4:
                break  # the goal item, or all that the next step needs
        into = INTO[q]
        for before, x in into:
            if x != "s" and not final[4 * covered + before]:
                push(agenda, (cost + INSERT, covered, 73, before))  # I
        if i == begin:
            continue
        row = rows[i - 1]
        covered += 1
        if not final[4 * covered + q]:
            push(agenda, (cost + DELETE, covered, 68, q))  # D
        if row == "d":
            continue
        own, more = row.lower(), TRUNCATED if row.isupper() else 0
        for before, x in into:
            if not final[4 * covered + before]:
                if x == own:
                    push(agenda, (cost + more, covered, 75, before))  # K
                if x != "s":
                    push(agenda, (cost + more + REROLE, covered, 82, before))  # R
    return costs


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations after the contract's damage, with ``live`` false for the dropped ones.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 removes the
    signs at ends of sentences, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    copies = F.when(kind == 0, F.array(F.lit(0))).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text("text"), ENDS, "")).otherwise(text("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).select("conv_id", "turn", "role", "text", (F.col("copy") > 0).alias("live"))


def plain(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damaged``; a null role or text counts as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    ids = [F.col(name).cast("long").alias(name) for name in ("conv_id", "turn")]
    return conversations.select(*ids, text("role"), text("text"), F.lit(True).alias("live"))


def _order() -> list[Column]:
    """Rows of a conversation in order; rows of one turn by role and digest."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


BLOCKS = (
    ("conv_id", "long"),
    ("block", "long"),
    ("letters", "string"),
    ("first", "string"),
    ("last", "string"),
    ("least", "long"),
    ("most", "long"),
    ("turns", "long"),
    ("blank", "long"),
    ("duplicate", "long"),
    ("truncated", "long"),
    ("illegal", "long"),
)
LEGAL = {"su", "ua", "au"}


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row per conversation and block of turns: its rows' letters and the counts inside it."""
    body = F.rtrim("text", F.lit(SPACE))
    described = rows.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        "role",
        F.sha2("text", 256).alias("digest"),
        (body == "").alias("blank"),
        F.right(body, F.lit(1)).isin(*ENDS).alias("ended"),
        "live",
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    seen = described.withColumn("fault", fault).select("conv_id", "block", "turn", "role", "digest", "fault", "live")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, letters = None, None, []
        done = [[] for _ in BLOCKS]

        def finish():
            for column, value in zip(done, (*now, "".join(letters), *own), strict=True):
                column.append(value)

        for batch in batches:
            for conv, block, turn, role, fault, live in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (conv, block) != now:
                    if now is not None:
                        finish()
                    now, own, letters, last_turn = (conv, block), [None, None, None, None, 0, 0, 0, 0, 0], [], None
                if not live:
                    continue
                initial = role[:1]
                letters.append(code(initial, fault))
                if own[0] is None:
                    own[0] = initial
                elif own[1] + initial not in LEGAL:
                    own[8] += 1
                own[1] = initial
                if turn is not None and turn != last_turn:
                    own[2], own[3], own[4], last_turn = turn if own[2] is None else own[2], turn, own[4] + 1, turn
                if fault:
                    own[{"blank": 5, "duplicate": 6, "truncated": 7}[fault]] += 1
            if len(done[0]) >= 1000:
                yield batch_of(BLOCKS, done)
                done = [[] for _ in BLOCKS]
        if now is not None:
            finish()
        yield batch_of(BLOCKS, done)

    prepare(rows.sparkSession)
    # Of equal rows of one turn the one that is no duplicate stands first.
    dealt = seen.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *_order(), F.col("fault") == "duplicate")
    return dealt.select("conv_id", "block", "turn", "role", "fault", "live").mapInArrow(run, schema_of(BLOCKS))


AUDITS = (
    ("conv_id", "long"),
    ("gaps", "long"),
    ("blank", "long"),
    ("duplicate", "long"),
    ("truncated", "long"),
    ("illegal", "long"),
    ("cost", "long"),
    ("audit", "string"),
)


def audits_of(blocks: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation, from its blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, sums = object(), [], None

        def finished():
            least, most, turns, blank, duplicate, truncated, illegal, _ = sums
            cost, audit = lightest("".join(letters))
            gaps = 0 if least is None else most - least + 1 - turns
            return batch_of(AUDITS, [[x] for x in (now, gaps, blank, duplicate, truncated, illegal, cost, audit)])

        for batch in batches:
            for conv, _, own, first, last, least, most, turns, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sums is None or conv != now:
                    if sums is not None:
                        yield finished()
                    now, letters, sums = conv, [], [None, None, 0, 0, 0, 0, 0, None]
                if first is None:
                    continue
                letters.append(own)
                if least is not None:
                    sums[0] = least if sums[0] is None else sums[0]
                    sums[1], sums[2] = most, sums[2] + turns
                for k, count in enumerate(counts):
                    sums[3 + k] += count
                sums[6] += sums[7] is not None and sums[7] + first not in LEGAL
                sums[7] = last
        if sums is not None:
            yield finished()

    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, schema_of(AUDITS))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place, role, text, edit."""
    fields = (("conv_id", "long"), ("place", "long"), ("role", "string"), ("text", "string"), ("edit", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _edited(batches):
            out = [(head[0], *row) for head, *row in part if row[0] is not None]
            yield batch_of(fields, list(zip(*out, strict=True)) or [[] for _ in fields])

    return _behind_audits(rows, audits).mapInArrow(run, schema_of(fields))


def _behind_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows in order behind their conversation's audit, which is an extra first row."""
    own = rows.where("live").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), "text"
    )
    heads = audits.withColumn("part", F.lit(0))
    dealt = heads.unionByName(own, allowMissingColumns=True)
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "part", *_order())
    return dealt.select("part", "role", "text", *[name for name, _ in AUDITS])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(head, place, role, text, edit) of the repaired rows, the head being their conversation's row
    of ``audits_of``; a row of place None ends a conversation."""
    head, audit, at, q, place = None, "", 0, START, 0

    def inserted(out):
        nonlocal at, q, place
        while at < len(audit) and audit[at] == "I":
            out.append((head, place, ROLE[WANTED[q]], "", "I"))
            q, at, place = NEXT[q, WANTED[q]], at + 1, place + 1

    for batch in batches:
        out = []
        for part, role, text, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part == 0:
                if head is not None:
                    inserted(out)
                    out.append((head, None, None, None, None))
                head, audit, at, q, place = own, own[-1], 0, START, 0
                continue
            inserted(out)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            kept = role if edit == "K" else ROLE[WANTED[q]]
            out.append((head, place, kept, text, edit))
            q, place = NEXT[q, kept[0]], place + 1
        yield out
    if head is not None:
        out = []
        inserted(out)
        out.append((head, None, None, None, None))
        yield out


FIELDS = (*AUDITS, ("repaired_sha256", "string"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of rows in the form of ``plain`` or ``damaged``.

    Conversations are told apart by conv_id, null being one of them. Rows are taken by turn, nulls
    first, rows of one turn by role and then by the digest of the text. The first fault of a row
    counts: blank, duplicate (role and text seen earlier), truncated (no sign at its end). A
    conversation without live rows has an empty audit. Other columns are not read.
    """
    audits = audits_of(blocks_of(rows))
    return audits, repaired(rows, audits)


def digests(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of every conversation's repaired ``role:text`` lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hashlib.sha256()
        for part in _edited(batches):
            out = []
            for head, place, role, text, _ in part:
                if place is None:
                    out.append((*head, own.hexdigest()))
                    own = hashlib.sha256()
                else:
                    own.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield batch_of(FIELDS, list(zip(*out, strict=True)) or [[] for _ in FIELDS])

    return _behind_audits(rows, audits_of(blocks_of(rows))).mapInArrow(run, schema_of(FIELDS))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: faults after the damage, cost, audit, hash of the repair."""
    return digests(damaged(conversations))

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the words of all items of a block; a transition exists for every word
that follows in some item. Training words are streamed through it and each position carries the
length of the longest item passage that ends there. From that length follow the hit windows; the
state names the items. The automaton's size is linear in the block's words.

Tasks cut the items into pieces and deal these to blocks of bounded size, stored in the shared folder.
One block at a time is sent to the tasks, which scan all documents for it and return hits alone; a
worker holds one automaton. A benchmark of one block needs one pass and no shuffle; with more, hits are added up by
the number that each stored document got.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, map_rows, map_slices, prepare, schema_of, slices, store, whole

WINDOW = 13
#: Words of items in one automaton: about 100 bytes each in a worker.
BLOCK_WORDS = 500_000
#: Letters that count as one word more.
WORD_LETTERS = 64

#: Characters of words, a fixed pattern.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: White space that goes with a removed passage: up to the end of its line.
AFTER = re.compile(r"[^\S\n]*")
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}

def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


class Automaton:
    """Generalised suffix automaton over words, with the items of each 13-word passage."""

    def __init__(self, items: Iterable[tuple[str | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        #: state -> items one of whose windows is that passage, by the passage's length
        self.owners: dict[int, dict[int, set[str | None]]] = {}
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for name, words in items:
            size = min(window, len(words))
            state = length = 0
            for i, word in enumerate(words):
                state, length = self.step(state, length, word)
                state, length = self.cut(state, length, size)
                if i + 1 >= size:
                    self.owners.setdefault(state, {}).setdefault(size, set()).add(name)
        self.marks = self._marks()

    def _extend(self, last: int, word: str) -> int:
        to, link, length = self.next, self.link, self.length
        found = to[last].get(word)
        if found is not None:
            if length[found] == length[last] + 1:
                return found
            return self._split(last, word, found)
        state = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in to[at]:
            to[at][word] = state
            at = link[at]
        if at >= 0:
            found = to[at][word]
            link[state] = found if length[found] == length[at] + 1 else self._split(at, word, found)
        return state

    def _split(self, at: int, word: str, found: int) -> int:
        to, link, length = self.next, self.link, self.length
        clone = len(to)
        to.append(dict(to[found]))
        link.append(link[found])
        length.append(length[at] + 1)
        link[found] = clone
        while at >= 0 and to[at].get(word) == found:
            to[at][word] = clone
            at = link[at]
        return clone

    def _marks(self) -> list[int]:
        """For each state, itself or its nearest suffix state that ends a window, or -1."""
        marks = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            if state in self.owners:
                marks[state] = state
            elif state:
                marks[state] = marks[self.link[state]]
        return marks

    def step(self, state: int, length: int, word: str) -> tuple[int, int]:
        """The longest passage that ends with the next word."""
        to = self.next
        while state and word not in to[state]:
            state = self.link[state]
            length = self.length[state]
        if word in to[state]:
            return to[state][word], length + 1
        return 0, 0

    def cut(self, state: int, length: int, most: int) -> tuple[int, int]:
        """The suffix of at most ``most`` words of the current passage."""
        if length > most:
            length = most
            while self.length[self.link[state]] >= most:
                state = self.link[state]
        return state, length

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit windows as merged [start, end) word ranges, and the items they come from."""
        to, link, longest, marks, window = self.next, self.link, self.length, self.marks, self.window
        start = to[0]
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        state = length = 0
        for i, word in enumerate(words):
            found = to[state].get(word)
            if found is None:
                if word not in start:
                    state = length = 0
                    continue
                while found is None:
                    state = link[state]
                    found = to[state].get(word)
                length = longest[state]
            state = found
            length += 1
            if length > window:
                length = window
                while longest[link[state]] >= window:
                    state = link[state]
            at = marks[state]
            while at > 0:
                for size, names in self.owners.get(at, {}).items():
                    if size <= length:
                        items |= names
                        if ranges and ranges[-1][1] >= i + 1 - size:
                            first = i + 1 - size
                            while ranges and ranges[-1][1] >= first:
                                first = min(first, ranges.pop()[0])
                            ranges.append((first, i + 1))
                        else:
                            ranges.append((i + 1 - size, i + 1))
                at = marks[link[at]]
        return ranges, items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


PIECES = (("block", "long"), ("item_id", "string"), ("words", "array<string>"))


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> tuple[int, DataFrame]:
    """(number of blocks, stored pieces ``block, item_id, words``): about ``most`` words a block, at most twice that.

    An item longer than a 64th of a block is cut into pieces that share ``WINDOW`` - 1 words, so that no
    window is lost. Equal items of one id are one. Null texts and texts without a word have no
    windows. An item without an id has windows like any other; its name is None.
    """
    length = max(1, most // 64)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole().alias("text")).distinct()

    def cut(names, texts):
        out = ([], [], [])
        for name, text in zip(names, texts, strict=True):
            words = words_of(text)
            for at in range(0, max(1, len(words) - WINDOW + 1) if words else 0, length):
                out[0].append(at)
                out[1].append(name)
                out[2].append(words[at : at + length + WINDOW - 1])
        return out

    fields = (("at", "long"), ("item_id", "string"), ("words", "array<string>"))
    pieces = store(map_slices(rows, cut, fields), "items")
    letters = F.aggregate("words", F.lit(0).cast("long"), lambda total, word: total + F.length(word))
    # Long words count for more, so that a block is bounded in bytes too.
    weight = F.size("words") + F.floor(letters / WORD_LETTERS)
    total = pieces.agg(F.sum(weight)).first()[0] or 0
    many = -(-total // most)
    number = F.pmod(F.xxhash64("item_id", "at", "words"), F.lit(max(many, 1))).alias("block")
    return many, pieces.select(number, "item_id", "words")


_BUILT: dict[str, Automaton] = {}


def _automaton(token: str, items) -> Automaton:
    """The block's automaton, built once per worker process; the one before it goes."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Automaton(items.value)
    return _BUILT[token]


SCANNED = (
    ("rid", "long"),
    ("doc_id", "long"),
    ("n_words", "long"),
    ("ranges", "array<long>"),
    ("items", "array<string>"),
)


def _passes(rows: DataFrame, cut_items: tuple[int, DataFrame], every: bool) -> DataFrame:
    """Hits of all blocks by ``rid`` for rows (rid, doc_id, text): of all rows if ``every``, else of those with a hit."""
    spark = rows.sparkSession
    prepare(spark)
    many, pieces = cut_items
    found = None
    for block in range(max(many, 1)):
        items = [(r["item_id"], r["words"]) for r in pieces.where(F.col("block") == block).collect()]  # bounded
        shared, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex
        whole_table = every and block == 0

        def run(batches, shared=shared, token=token, whole_table=whole_table):
            for rids, doc_ids, texts in slices(batches):
                automaton, out = _automaton(token, shared), []
                for rid, doc_id, text in zip(rids, doc_ids, texts, strict=True):
                    words = words_of(text)
                    ranges, names = automaton.scan(words)
                    if names or whole_table:
                        out.append((rid, doc_id, len(words), [x for pair in ranges for x in pair], list(names)))
                yield batch_of(SCANNED, list(zip(*out, strict=True)) or [[] for _ in SCANNED])

        hits = rows.select("rid", "doc_id", "text").mapInArrow(run, schema_of(SCANNED))
        if many > 1:
            hits = store(hits, "hits")  # done before the next block is sent
            shared.destroy()
        found = hits if found is None else found.union(hits)
    return found if many <= 1 else _added(found)


def _added(hits: DataFrame) -> DataFrame:
    """One row per document from the hits of several blocks."""
    once = hits.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.flatten(F.collect_list("items")).alias("items"),
    )

    def of_row(rid, doc_id, n_words, ranges, items):
        pairs = merged(zip(ranges[::2], ranges[1::2], strict=True))
        return rid, doc_id, n_words, [x for pair in pairs for x in pair], list(set(items))

    return map_rows(once, of_row, SCANNED)


def numbered(documents: DataFrame, *columns: str) -> DataFrame:
    """Documents with ``rid``, a number of their own that is settled by being written."""
    return store(documents.select(F.monotonically_increasing_id().alias("rid"), *columns), "numbered")


def scanned(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hit word ranges (start, end, start, ...) and hit items, over all blocks."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    cut_items = blocks(benchmark, most)
    if cut_items[0] > 1:
        rows = numbered(rows, "doc_id", "text")
    else:
        rows = rows.withColumn("rid", F.lit(0).cast("long"))  # one pass: nothing is added up
    return _passes(rows, cut_items, True).drop("rid")


def contamination(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Words, hit words and hit items of every document; ``most`` bounds a block of items in words.

    A null text has no words and is not contaminated; an item without words has no window; an
    empty benchmark hits nothing. Items with a null item_id count as one item more, as in the SQL;
    the hash of the ids leaves it out. Rows are independent: null ids and repeated rows are kept as
    they come, other columns are not read.
    """
    # Ranges alternate between start and end: ends count plus, starts minus.
    hit = F.aggregate(
        F.transform("ranges", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, b: a + b
    )
    rows = scanned(documents, benchmark, most).withColumn("n_hit", hit)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given word ranges and the white space after each."""
    places = [m.span() for m in WORD.finditer(lowered(text))]
    out, at = [], 0
    for start, end in ranges:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
        at = AFTER.match(text, at).end()
    return "".join([*out, text[at:]])


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, least_share: float = 0.05, drop_share: float = 0.5
) -> DataFrame:
    """The table with contaminated passages removed from ``text``; all columns stay.

    A document whose hit words reach ``least_share`` of its words loses the hit spans; where they
    reach ``drop_share``, the document goes. All others stay as they are, null texts too. Columns
    other than ``text`` and ``n_chars`` are carried along unread, whatever their names. A worker
    holds the automaton of one block, about 100 bytes a word.
    """
    many, pieces = blocks(benchmark)
    packed = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("old"), whole().alias("text"))

    def judged(text: str, ranges: list[tuple[int, int]], n_words: int) -> str | None:
        hit = sum(end - start for start, end in ranges)
        if not hit or hit < least_share * n_words:
            return text
        return None if hit >= drop_share * n_words else without(text, ranges)

    spark = documents.sparkSession
    prepare(spark)
    if many <= 1:
        items = [(r["item_id"], r["words"]) for r in pieces.collect()]  # one block, bounded
        shared, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            automaton, out = _automaton(token, shared), []
            for text in texts:
                words = words_of(text)
                out.append(judged(text, automaton.scan(words)[0], len(words)))
            return pd.Series(out, dtype=object)

        packed = packed.withColumn("new", cut("text"))
    else:
        packed = numbered(packed, "row", "old", "text")
        hits = _passes(packed.withColumn("doc_id", F.lit(None).cast("long")), (many, pieces), False)

        @F.pandas_udf("string")
        def cut(texts: pd.Series, ranges: pd.Series, counts: pd.Series) -> pd.Series:
            out = []
            for text, own, n in zip(texts, ranges, counts, strict=True):
                pairs = [] if own is None else list(zip(own[::2], own[1::2], strict=True))
                out.append(judged(text, [(int(a), int(b)) for a, b in pairs], n))
            return pd.Series(out, dtype=object)

        joined = packed.join(hits.select("rid", "ranges", "n_words"), "rid", "left")
        packed = joined.withColumn("new", cut("text", "ranges", F.coalesce("n_words", F.lit(0))))

    packed = packed.where("old IS NULL OR new IS NOT NULL")
    changed = F.col("old").isNotNull() & (F.col("new") != F.col("old"))
    kinds = {field.name: field.dataType for field in documents.schema}
    return packed.select(
        *[
            F.when(changed, {"text": F.col("new"), "n_chars": F.length("new")}[name].cast(kinds[name]))
            .otherwise(F.col("row")[name])
            .alias(name)
            if name in ("text", "n_chars")
            else F.col("row")[name].alias(name)
            for name in documents.columns
        ]
    )

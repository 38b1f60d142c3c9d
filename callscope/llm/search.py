"""Ranked lexical search: a block index in Spark tables, and Block-Max MaxScore over it.

Index. Each task cuts its rows into shards of documents that follow each other. A shard has one row
of document numbers and lengths, and one row per term and block of postings: number of postings,
first and last document, the pairs (tf, least length) that no other pair of the block outdoes,
and the postings themselves as compressed bytes. Document frequencies, N and L come from the short
columns alone. Terms that no item asks for are not indexed: a bit map of fixed size over hashed terms
says which may be asked for, and a join on the term settles the rest.

Search. A shard meets its items' rows in one task, which keeps one heap of the best per item from
shard to shard. With the least score in the heap as threshold, a shard's lists are put in order of
their greatest score; those whose greatest scores together stay below the threshold are not
essential. Candidates come from the essential lists. They meet the other lists from the greatest
on, and one whose score so far plus the greatest score of its block of that list, plus those of the
lists still to come, stays below the threshold goes before the block is decompressed. The heaps
of all tasks are merged by a window.

Scores are whole numbers of 64 bits, so that nothing depends on the order of adding up.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, map_slices, prepare, schema_of, slices, store, whole

#: Documents and postings of a shard, postings of a block.
SHARD_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
BLOCK = 128
#: Bits of the map of terms that items ask for: one megabyte, whatever the items are.
MAP_BITS = 1 << 23
#: Terms of the items that go through the index together, about; more items make more passes over it.
ITEM_TERMS = 1 << 16
TOP = 50
#: Shards that go through one heap per item, where there are enough of them; lanes kept busy before that.
LANE_SHARDS = 8
LANES = 32
#: Terms whose bit a worker remembers.
KNOWN_TERMS = 500_000

#: Bytes that separate terms become spaces, A-Z become small; all others stay.
LETTERS = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32 for byte in range(256)
)


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(LETTERS).split()


def vbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, the highest bit on all but the last."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[ends[has] - sizes[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def from_vbytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, np.int64)


INDEX = (
    ("shard", "long"),
    ("term", "string"),
    ("block", "int"),
    ("n", "long"),
    ("first", "int"),
    ("last", "int"),
    ("tfs", "binary"),
    ("lengths", "binary"),
    ("data", "binary"),
    ("doc_ids", "array<long>"),
)


class Shard:
    """Postings of documents that follow each other, collected by a task."""

    def __init__(self, number: int):
        self.number = number
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, length: int, counted: dict[bytes, int]) -> None:
        number, own = self.terms, len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.term.append(np.array([number.setdefault(x, len(number)) for x in counted], np.int64))
        self.tf.append(np.array(list(counted.values()), np.int64))
        self.doc.append(np.full(len(counted), own, np.int64))
        self.postings += len(counted)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The shard's own row, then one row per term and block."""
        lengths = np.array(self.lengths, np.int64)
        head = [[self.number], [None], [-1], [len(self.ids)], [0], [0], [b""], [lengths.tobytes()], [b""], [self.ids]]
        yield batch_of(INDEX, head)
        if not self.postings:
            return
        term, doc, tf = (np.concatenate(x) for x in (self.term, self.doc, self.tf))
        order = np.argsort(term, kind="stable")  # documents stay in order inside a term
        term, doc, tf = term[order], doc[order], tf[order]
        start_of_term = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        place = np.arange(len(term)) - np.repeat(start_of_term, np.diff(np.append(start_of_term, len(term))))
        start = np.flatnonzero(place % BLOCK == 0)
        stop = np.append(start[1:], len(term))
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]
        both = np.empty(2 * len(doc), np.int64)
        both[0::2], both[1::2] = gap, tf
        raw, sizes = vbytes(both)
        ends = np.cumsum(sizes)
        data = raw.tobytes()
        names = list(self.terms)
        out = [[] for _ in INDEX]
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            own_tf, own_length = frontier(tf[a:b], lengths[doc[a:b]])
            row = (
                self.number,
                names[term[a]].decode(),
                place[a] // BLOCK,
                b - a,
                int(doc[a]),
                int(doc[b - 1]),
                own_tf.tobytes(),
                own_length.tobytes(),
                data[ends[2 * a - 1] if a else 0 : ends[2 * b - 1]],
                None,
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
            if len(out[0]) >= 4096:
                yield batch_of(INDEX, out)
                out = [[] for _ in INDEX]
        yield batch_of(INDEX, out)


def frontier(tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with no other of at least that tf and at most that length."""
    if len(tf) == 1:
        return tf, length
    order = np.lexsort((length, -tf))
    tf, length = tf[order], length[order]
    least = np.minimum.accumulate(length)
    keep = np.concatenate([[True], length[1:] < least[:-1]])
    return tf[keep], length[keep]


def asked_map(items: DataFrame) -> DataFrame:
    """The bit map of the items' terms as rows (word, bits): at most MAP_BITS / 64 of them."""
    bit = F.crc32(F.col("term").cast("binary")) % MAP_BITS
    named = items.select(bit.cast("long").alias("bit"))
    word = named.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("bits"))
    return word.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Different (item_id, set of terms) of the items that have terms."""

    def of_slice(ids, texts):
        return [ids, [sorted({t.decode() for t in terms(text)}) for text in texts]]

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole().alias("text"))
    asked = map_slices(rows, of_slice, (("item_id", "long"), ("terms", "array<string>")))
    return asked.where(F.size("terms") > 0).distinct()


def build(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """The stored index of all documents for the terms in ``asked`` (and perhaps a few more)."""
    spark = documents.sparkSession
    found = asked_map(asked).collect()  # bounded: MAP_BITS / 64 rows
    words = np.zeros(MAP_BITS // 64, np.int64)
    for word, bits in found:
        words[word] = bits
    bit_map = spark.sparkContext.broadcast(words.tobytes())

    class Known(dict):
        def __missing__(self, term):
            if len(self) >= KNOWN_TERMS:
                self.clear()
            at = zlib.crc32(term) % MAP_BITS
            answer = self[term] = bool(bit_map.value[at >> 3] >> (at & 7) & 1)
            return answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = Known(), 0
        base = TaskContext.get().partitionId() << 32
        shard = Shard(base)
        for ids, texts in slices(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                found = terms(text)
                counted = Counter(found)
                shard.add(doc_id, len(found), {t: n for t, n in counted.items() if known[t]})
                if shard.full():
                    yield from shard.rows()
                    made += 1
                    shard = Shard(base + made)
        if shard.ids:
            yield from shard.rows()

    prepare(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return store(rows.mapInArrow(run, schema_of(INDEX)), "index")


def weights(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """term and weight of the terms that are asked for and occur."""
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    inverse = (F.lit(2 * n + 2).cast("double")) / (2 * F.col("df") + 1)
    return df.join(asked.select("term").distinct(), "term").select("term", F.floor(1000 * F.log(inverse)).alias("w"))


class Scorer:
    """Scores of one corpus: ``size`` documents with terms, ``total`` terms in all."""

    def __init__(self, size: int, total: int):
        self.size, self.total = size, total

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n * self.size) // max(self.total, 1)

    def scores(self, w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class List:
    """A term's blocks in a shard; postings are decompressed when they are first asked for."""

    def __init__(self, w: int, scorer: Scorer, m: np.ndarray):
        self.w, self.scorer, self.m = w, scorer, m
        self.first, self.last, self.most, self.data = [], [], [], []
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, first: int, last: int, tfs: bytes, lengths: bytes, data: bytes) -> None:
        tf, n = np.frombuffer(tfs, np.int64), np.frombuffer(lengths, np.int64)
        self.first.append(first)
        self.last.append(last)
        self.most.append(int(self.scorer.scores(self.w, tf, self.scorer.lengths(n)).max()))
        self.data.append(data)

    def close(self) -> None:
        self.first, self.last, self.most = (np.array(x, np.int64) for x in (self.first, self.last, self.most))
        self.bound = int(self.most.max())

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if k not in self.made:
            values = from_vbytes(self.data[k])
            doc = np.cumsum(values[0::2])
            self.made[k] = doc, self.scorer.scores(self.w, values[1::2], self.m[doc])
        return self.made[k]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            parts = [self.block(k) for k in range(len(self.data))]
            self.all = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.all

    def at(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores of documents that lie in the given blocks; 0 where the term does not occur."""
        out = np.zeros(len(docs), np.int64)
        if not len(docs):
            return out
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() + [len(docs)]
        for a, b in zip(edges, edges[1:], strict=False):
            own, scores = self.block(int(blocks[a]))
            place = np.minimum(np.searchsorted(own, docs[a:b]), len(own) - 1)
            out[a:b] = np.where(own[place] == docs[a:b], scores[place], 0)
        return out


def best_of(lists: list[List], threshold: int, size: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard and their scores: all with a score of ``threshold`` or more that can be
    among the shard's best ``top``, and perhaps others.

    ``size`` is the number of documents in the shard.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    together = np.cumsum([x.bound for x in lists])
    few = int(np.searchsorted(together, threshold, "left"))  # of these all scores together stay below
    if few == len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(size, np.int64)
    for x in lists[few:]:
        doc, score = x.whole()
        total[doc] += score
    docs = np.flatnonzero(total)
    score = total[docs]
    for k in range(few - 1, -1, -1):
        if len(docs) > top:
            threshold = max(threshold, int(np.partition(score, -top)[-top]))
        x = lists[k]
        behind = int(together[k - 1]) if k else 0
        keep = score + x.bound + behind >= threshold
        docs, score = docs[keep], score[keep]
        block = np.searchsorted(x.last, docs)
        inside = block < len(x.last)
        block[~inside] = 0
        inside &= x.first[block] <= docs
        most = np.where(inside, x.most[block], 0)
        keep = score + most + behind >= threshold  # before any block is decompressed
        docs, score, block, inside = docs[keep], score[keep], block[keep], inside[keep]
        score[inside] += x.at(docs[inside], block[inside])
    keep = score >= threshold
    return docs[keep], score[keep]


class Best:
    """The best documents of an item so far: highest score, then least id, null ids last."""

    def __init__(self, top: int):
        self.top, self.heap = top, []  # of (score, no id, -id), least first

    def threshold(self) -> int:
        return self.heap[0][0] if len(self.heap) >= self.top else 1

    def add(self, doc_id: int | None, score: int) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


FOUND = (("item_id", "long"), ("asked", "string"), ("doc_id", "long"), ("score", "long"))


def search(documents: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of highest score for every item: item_id, rank, doc_id, score.

    Scores and terms are those of the contract: integers, terms over the whole text. A null text has
    no terms; an item without terms has no rows. Every row of ``documents`` counts by itself, so
    repeated rows take ranks of their own; null ids come last among equal scores. Items are the
    different pairs of item_id and set of terms; a repeated one is answered once. Other columns are not read.
    """
    spark = documents.sparkSession
    items = store(items_of(benchmark), "items")
    each = items.select("item_id", F.explode("terms").alias("term"))
    index = build(documents, each)
    lengths = index.where("term IS NULL").select("lengths")

    def counted(data):
        n = [np.frombuffer(x, np.int64) for x in data]
        return [[int((x > 0).sum()) for x in n], [int(x.sum()) for x in n]]

    sums = map_slices(lengths, counted, (("size", "long"), ("total", "long")))
    zero = lambda name: F.coalesce(F.sum(name), F.lit(0))
    size, total, shards = sums.agg(zero("size"), zero("total"), F.count(F.lit(1))).first()
    scorer = Scorer(size, total)
    weighed = store(weights(index, each, size), "weights")

    # Items are asked in groups by their hash, as many as the number of their terms calls for.
    n_terms = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-n_terms // ITEM_TERMS) or 1
    asked = F.sha2(F.concat_ws(" ", "terms"), 256).alias("asked")
    group = F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups)).cast("int").alias("grp")
    grouped = items.select("item_id", asked, group, "terms")
    n_lanes = max(1, min(LANES, shards), shards // LANE_SHARDS)
    lane = F.pmod(F.xxhash64("shard"), F.lit(n_lanes)).cast("int").alias("lane")

    # Item rows go to every lane, postings to the groups that ask for their term, shards to all groups.
    lanes = F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))).alias("lane")
    heads = grouped.select("grp", lanes, F.lit(-1).cast("long").alias("shard"), F.lit(0).alias("kind"), "item_id", "asked", "terms")
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    shards = index.where("term IS NULL").select(all_groups, lane, "shard", F.lit(1).alias("kind"), "lengths", "doc_ids")
    wanted = grouped.select("grp", F.explode("terms").alias("term")).distinct().join(weighed, "term")
    blocks = index.where("term IS NOT NULL").join(wanted, "term").where("w != 0").select(
        "grp", lane, "shard", F.lit(2).alias("kind"), "term", "w", "block", "first", "last", "tfs", "lengths", "data"
    )
    rows = heads.unionByName(shards, True).unionByName(blocks, True)
    names = ["grp", "lane", "shard", "kind", "item_id", "asked", "terms", "term", "w", "block", "first", "last", "tfs", "lengths", "data", "doc_ids"]
    dealt = rows.select(*names).repartitionById(n_lanes, F.col("lane")).sortWithinPartitions("grp", "lane", "shard", "kind", "term", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked_items, best = None, [], []
        shard, lists, ids, m = None, {}, None, None

        def searched():
            for x in lists.values():
                x.close()
            for (_, _, wanted), own in zip(asked_items, best, strict=True):
                found = [lists[t] for t in wanted if t in lists]
                if not found:
                    continue
                docs, scores = best_of(found, own.threshold(), len(m), top)
                if len(docs) > top:  # those of equal score all stay
                    least = np.partition(scores, -top)[-top]
                    docs, scores = docs[scores >= least], scores[scores >= least]
                for doc, score in zip(docs.tolist(), scores.tolist(), strict=True):
                    own.add(ids[doc], score)

        def finished():
            out = [
                (item_id, name, -negative if has else None, score)
                for (item_id, name, _), own in zip(asked_items, best, strict=True)
                for score, has, negative in own.heap
            ]
            return batch_of(FOUND, list(zip(*out, strict=True)) or [[] for _ in FOUND])

        for columns in slices(batches, 1024):
            for row in zip(*columns, strict=True):
                key, at, kind = row[:2], row[2], row[3]
                if key != now or at != shard:
                    if lists:
                        searched()
                    shard, lists = at, {}
                if key != now:
                    if now is not None:
                        yield finished()
                    now, asked_items, best = key, [], []
                if kind == 0:
                    asked_items.append((row[4], row[5], row[6]))
                    best.append(Best(top))
                elif kind == 1:
                    ids, m = row[15], scorer.lengths(np.frombuffer(row[13], np.int64))
                else:
                    term, w, _, first, last, tfs, lengths, data = row[7:15]
                    if term not in lists:
                        lists[term] = List(w, scorer, m)
                    lists[term].add(first, last, tfs, lengths, data)
        if lists:
            searched()
        if now is not None:
            yield finished()

    prepare(spark)
    found = dealt.mapInArrow(run, schema_of(FOUND))
    order = Window.partitionBy("item_id", "asked").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")

"""Near copies by word shingles, found in a Gray-ordered index of SimHash fingerprints.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Fingerprints of shingles are too far apart at 0.8 to be found by few masks, those of single words are not: where 0.8
of the shingles agree, about 2 % of the words differ, and fingerprints of 128 bits over the sets of words differ in
some nine bits. So these lead to candidates, and the shingles of the whole texts decide.

1. Texts of the same words in a row are one node.
2. For each of ``MASKS`` choices of three bytes a fingerprint is written with these first and replaced by
   its Gray rank. Sorted, fingerprints of one masked pattern stand together, and inside a pattern those that share
   more leading bits. Patterns are taken in stretches of at most ``STRETCH`` rows in that order; in a stretch each node is
   linked to the ``BEFORE`` nearest rows before it, and to the one of smallest number among the nearest (within ``SLACK`` bits of the
   least difference), all in at most ``DISTANCE`` bits. So a node has at most five links per mask, however many copies there are, and copies of one text
   lead to the same few nodes from all masks.
3. Links are checked by the shingles of both texts; a text with many links is split over tasks. Components of the
   links that hold are the first groups.
4. What the index misses is found exactly. With each text's shingles in one order for all texts, two texts that are 0.8 alike
   share a shingle among the first fifth (and one) of each. Texts of different groups that meet there, and that can
   still be 0.8 alike by their numbers of shingles, the places of the shared ones and how many these are, are checked like
   links. The order is free; shingles that many texts share come last in it, so that few texts meet. Where many meet all the
   same, as in a family that is nearly 0.8 alike, all shingles of these texts are counted: those that no text of another group has
   are left out, texts that have too few others go, and the order is by the exact counts.
5. Components of all links that hold are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, discard, map_slices, prepare, schema_of, store, whole
from callscope.llm.components import stars
from callscope.llm.simhash import gray_ranks
from callscope.operators import skew

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of candidates may differ; masks, and the bytes in each.
DISTANCE = 24
#: Bits beyond the least difference within which the smallest node is chosen.
SLACK = 4
#: Nearest rows before a row that it is linked to.
BEFORE = 4
MASKS = 32
MASK_BYTES = 3
#: Rows of one pattern that are compared with each other.
STRETCH = 2048

#: One text in so many is read to name the shingles that come last in the order, and at most so many are named. Any
#: order gives the same pairs; a poor one only makes more texts meet.
ORDER_SHARE = 16
ORDER_NAMED = 1 << 17
#: Texts that meet in one shingle and are paired by one task.
MEETING = 1024
#: Where more texts than these meet in one shingle, all shingles of these texts are counted; rounds of that count.
CROWD = 80
CROWD_ROUNDS = 2
#: Numbers of 64 bits that bound from below how many shingles of two texts of a crowd differ.
WORDS = 8

_U = np.uint64
_FOLD = _U(0x9E3779B97F4A7C15)


def orders() -> list[list[int]]:
    """The sixteen bytes in order for each mask: different choices of three, drawn by a fixed seed."""
    draw, seen, out = np.random.default_rng(16), set(), []
    while len(out) < MASKS:
        order = draw.permutation(16).tolist()
        chosen = tuple(sorted(order[:MASK_BYTES]))
        if chosen not in seen:
            seen.add(chosen)
            out.append(order)
    return out


def words_of(text: str) -> list[bytes]:
    """Words of a text; only A-Z are lowered, only 20 and 09-0D split."""
    return text.encode().lower().split()


def fingerprint(words: list[bytes]) -> bytes:
    """128 bits: each is 1 if it is set in over half of the hashes of the different words."""
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(x) for x in set(words)])
    if not hashes:
        return bytes(16)
    counts, many = np.zeros(128, np.int64), len(hashes) // 16
    for at in range(0, many, 1 << 16):
        part = np.frombuffer(hashes[16 * at : 16 * (at + (1 << 16))], np.uint8).reshape(-1, 16)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many).tobytes()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The different runs of ``size`` words; all words where there are fewer."""
    return set(zip(*[words[k:] for k in range(size)])) if len(words) >= size else {tuple(words)}


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each of the different shingles, ascending."""
    of_word = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    many = max(len(words) - size + 1, 1)
    out = np.full(many, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = (out ^ of_word[k : k + many]) * _FOLD
        out ^= out >> _U(29)
    return np.unique(out)


def prefix_size(many: int, least: float = SIMILARITY) -> int:
    """How many shingles of a text, first in the order, hold one of every text that is ``least`` alike."""
    return min(many, many - math.ceil(least * many - 1e-9) + 1)


def similarity(a: list[bytes], b: list[bytes], size: int = SHINGLE) -> float:
    one, two = shingles(a, size), shingles(b, size)
    both = len(one & two)
    return both / (len(one) + len(two) - both)


ROWS = (
    ("doc_id", "long"),
    ("tie", "long"),
    ("s1", "long"),
    ("s2", "long"),
    ("print", "binary"),
    ("packed", "binary"),
)


def described(documents: DataFrame) -> DataFrame:
    """doc_id, tie, hash of the words in a row (two longs), fingerprint, and the words themselves, compressed."""

    def of_slice(ids, ties, texts):
        pack, out = zstandard.ZstdCompressor(level=1).compress, [[] for _ in range(4)]
        for text in texts:
            words = words_of(text)
            joined = b" ".join(words)
            same = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)
            for column, value in zip(out, (int(same[0]), int(same[1]), fingerprint(words), pack(joined)), strict=True):
                column.append(value)
        return [ids, ties, *out]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("tie"), whole().alias("text"))
    return map_slices(rows, of_slice, ROWS)


def _nearest(high: np.ndarray, low: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller node) inside one stretch: to the nearest rows before, and to the smallest number among the nearest."""
    own, other = [], []
    for at in range(0, len(high), 256):
        stop = min(at + 256, len(high))
        gone = np.bitwise_count(high[at:stop, None] ^ high[None, :]).astype(np.int16)
        gone += np.bitwise_count(low[at:stop, None] ^ low[None, :])
        gone[np.arange(stop - at), np.arange(at, stop)] = 999
        least = gone.min(axis=1)
        near = gone <= np.minimum(least + SLACK, DISTANCE)[:, None]
        smallest = np.where(near, nodes[None, :], np.iinfo(np.int64).max).min(axis=1)
        gone[np.arange(len(high))[None, :] > np.arange(at, stop)[:, None]] = 999
        links = [(least <= DISTANCE, smallest)]
        for _ in range(BEFORE):  # the nearest of the rows before, which every mask orders in its own way
            before = gone.argmin(axis=1)
            links.append((gone[np.arange(stop - at), before] <= DISTANCE, nodes[before]))
            gone[np.arange(stop - at), before] = 999
        for found, chosen in links:
            one, two = nodes[at:stop][found], chosen[found]
            own.append(np.maximum(one, two))
            other.append(np.minimum(one, two))
    return np.concatenate(own), np.concatenate(other)


def _links_of(combos: np.ndarray, high: np.ndarray, low: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside masked patterns; rows are sorted by (combo, rank), patterns are whole."""
    code_low = low ^ (low >> _U(1) | high << _U(63))
    code = high ^ (high >> _U(1))
    pattern = code >> _U(64 - 8 * MASK_BYTES)
    fresh = np.concatenate([[True], (combos[1:] != combos[:-1]) | (pattern[1:] != pattern[:-1])])
    starts = np.append(np.flatnonzero(fresh), len(code))
    sizes = np.diff(starts)
    # Patterns of two rows, most of those with any pair, are compared all at once.
    first = starts[:-1][sizes == 2]
    near = np.bitwise_count(code[first] ^ code[first + 1]).astype(np.int16) + np.bitwise_count(code_low[first] ^ code_low[first + 1])
    first = first[near <= DISTANCE]
    own, other = [np.maximum(nodes[first], nodes[first + 1])], [np.minimum(nodes[first], nodes[first + 1])]
    for a, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        for at in range(a, a + n, STRETCH):
            # A stretch begins with the last row of the one before, so that stretches hang together.
            begin, stop = max(a, at - 1), min(at + STRETCH, a + n)
            x, y = _nearest(code[begin:stop], code_low[begin:stop], nodes[begin:stop])
            own.append(x)
            other.append(y)
    return np.concatenate(own), np.concatenate(other)


def candidates(nodes: DataFrame) -> DataFrame:
    """Different pairs (a, b) of nodes whose fingerprints are near, by the masked patterns; ``nodes``: node, print."""
    ranked = (("combo", "int"), ("high", "long"), ("low", "long"), ("node", "long"))
    edge = (("a", "long"), ("b", "long"))
    chosen = orders()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 16)
            for combo, order in enumerate(chosen):
                turned = np.ascontiguousarray(data[:, order]).view(">u8").astype(np.uint64)
                high, low = gray_ranks(turned[:, 0].copy()), gray_ranks(turned[:, 1].copy())
                low = np.where(np.bitwise_count(turned[:, 0]) % 2 == 1, ~low, low)
                yield batch_of(ranked, [np.full(len(own), combo, np.int32), high.view(np.int64), low.view(np.int64), own])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for batch in batches:
            new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            new[1], new[2] = new[1].view(np.uint64), new[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            top = held[1] >> _U(64 - 8 * MASK_BYTES)
            # The last pattern may go on in the next batch; a very long one is cut into stretches.
            other = np.flatnonzero((held[0] != held[0][-1]) | (top != top[-1]))
            cut = other[-1] + 1 if len(other) else 0
            if len(held[0]) - cut > 8 * STRETCH:
                cut = len(held[0])
                yield batch_of(edge, _links_of(*held))
                held = [x[-1:] for x in held]
            elif cut:
                yield batch_of(edge, _links_of(*[x[:cut] for x in held]))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield batch_of(edge, _links_of(*held))

    prepare(nodes.sparkSession)
    rows = nodes.select("node", "print").mapInArrow(rank, schema_of(ranked))
    rows = rows.withColumn("pattern", F.shiftright("high", 64 - 8 * MASK_BYTES)).repartition("combo", "pattern")
    found = rows.sortWithinPartitions("combo", "high", "low").drop("pattern").mapInArrow(search, schema_of(edge))
    return found.distinct()


def checked(pairs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar, by the shingles of both."""
    ends = store(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    texts = store(nodes.select("node", "packed").join(ends, "node", "left_semi"), "texts")
    side = lambda name: texts.select(F.col("node").alias(name), F.col("packed").alias(f"text_{name}"))
    # Both sides stand on plain shuffles of stored tables, of which Spark splits the partitions of a hot text.
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def of_slice(a, b, first, second):
        unpack, out = zstandard.ZstdDecompressor().decompress, ([], [])
        for x, y, one, two in zip(a, b, first, second, strict=True):
            if similarity(unpack(one).split(b" "), unpack(two).split(b" "), size) >= least:
                out[0].append(x)
                out[1].append(y)
        return out

    return map_slices(both.select("a", "b", "text_a", "text_b"), of_slice, (("a", "long"), ("b", "long")), 64)


def _hashes_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (shingle_hashes(unpack(text).split(), size) for text in texts)


def shared_by_many(nodes: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of shingles that many of the texts share, and in how many of those read they are."""

    def hashes(packed):
        return [np.concatenate(list(_hashes_of(packed, size))).view(np.int64)]

    some = nodes.where(F.pmod("s1", F.lit(ORDER_SHARE)) == 0).select("packed")
    counted = map_slices(some, hashes, (("shingle", "long"),)).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    named = counted.where("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_NAMED).toArrow()
    found, many = (named.column(k).to_numpy() for k in range(2))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], many[order]


def _of_several(rows: DataFrame, by: str) -> DataFrame:
    """Rows at shingles with more than one value of ``by``, with their count ``n`` there."""
    same = Window.partitionBy("shingle")
    ends = rows.select("*", F.min(by).over(same).alias("_lo"), F.max(by).over(same).alias("_hi"), F.count(F.lit(1)).over(same).alias("n"))
    return ends.where("_lo < _hi").drop("_lo", "_hi")


def _met(rows: DataFrame, size: str, names: list[str], least: float, more: Callable | None = None) -> DataFrame:
    """Rows of two groups that meet in a shingle and can be similar there; ``names``, ending in _a and _b, and ``needed`` shingles in common.

    ``place`` is a shingle's place among the ``size`` of its text. A shingle in which very many texts meet (``n``) is dealt to tasks on
    one side and repeated on the other.
    """
    dealt = rows.withColumn("parts", F.ceil(F.col("n") / MEETING).cast("int"))
    one = dealt.select("shingle", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), *[F.col(x).alias(f"{x}_a") for x in names])
    two = dealt.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(x).alias(f"{x}_b") for x in names])
    place, of, many = ([F.col(f"{x}_{side}") for side in "ab"] for x in ("place", size, "many"))
    needed = least / (1 + least) * (many[0] + many[1]) - 1e-6
    # Whichever shared shingle this is: no more than it and those before it in both, and those after it in both.
    can = F.least(*place) + F.least(of[0] - place[0], of[1] - place[1]) >= needed
    can &= F.least(*many) + 1e-6 >= least * F.greatest(*many)
    if more is not None:
        can &= more(needed)
    return one.join(two, ["shingle", "part"]).where((F.col("root_a") < F.col("root_b")) & can).withColumn("needed", needed)


def _in_crowds(nodes: DataFrame, crowd: DataFrame, size: int, least: float) -> DataFrame:
    """Different pairs (a, b) of ``crowd`` (node, root) that are of two groups and can be similar; no similar pair is left out.

    Here all shingles are counted, over the crowd alone. What no text of another group has cannot be in common, so a text
    may have too few others for any partner of a size that there is. Of the rest, the rarest few hold one of every partner's.
    """
    fields = (("shingle", "long"), ("node", "long"), ("root", "long"), ("many", "int"))

    def all_shingles(ids, roots, packed):
        out = []
        for node, root, hashes in zip(ids, roots, _hashes_of(packed, size), strict=True):
            n = len(hashes)
            out.append((hashes.view(np.int64), np.full(n, node), np.full(n, root), np.full(n, n, np.int32)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    words = [f"word{k}" for k in range(WORDS)]
    rows = store(map_slices(nodes.join(crowd, "node").select("node", "root", "packed"), all_shingles, fields, 64), "crowd")
    for _ in range(CROWD_ROUNDS):
        counted = rows.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("n"), F.min("many").alias("low"), F.min("root").alias("lo"), F.max("root").alias("hi")
        )
        shared = rows.select("shingle", "node", "root", "many").join(counted.where("lo < hi").drop("lo", "hi"), "shingle")
        # No partner is smaller than the smallest text at any of these shingles, nor than the similarity allows.
        partner = F.min(F.greatest("low", F.ceil(least * F.col("many") - 1e-9)))
        bit = "shiftleft(1L, cast(pmod(shiftright(shingle, 8), 64) as int))"
        enough = shared.groupBy("node").agg(
            F.count(F.lit(1)).alias("held"),
            F.ceil(least / (1 + least) * (F.first("many") + partner) - 1e-6).alias("fewest"),
            *[F.expr(f"bit_xor(if(pmod(shingle, {WORDS}) = {k}, {bit}, 0L))").alias(word) for k, word in enumerate(words)],
        )
        enough = store(enough.where("held >= fewest"), "enough")
        kept = store(shared.join(enough.select("node", "held", "fewest"), "node"), "crowd")
        discard(rows)
        rows = kept
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle")) - 1
    first = rows.withColumn("place", place).where("place <= held - fewest").select("shingle", "node", "root", "many", "held", "place")
    first = _of_several(first, "root").join(enough.select("node", *words), "node")

    def near(needed):
        # A bit of a text says whether an odd number of its shingles fall on it: bits that differ are no more than shingles that do.
        differ = reduce(add, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words])
        return F.col("held_a") + F.col("held_b") - differ >= 2 * needed

    met = _met(first, "held", ["node", "root", "many", "place", "held", *words], least, near)
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def missed(nodes: DataFrame, roots: DataFrame, size: int, least: float) -> DataFrame:
    """Different pairs (a, b) of nodes that can be similar and are not in one group yet; no similar pair is left out.

    ``roots``: node, root, where a node is not a root itself. Groups count as one where they meet, so
    texts of one group are never paired, however many they are. Where more than ``CROWD`` texts meet, they are a crowd.
    """
    fields = (("shingle", "long"), ("node", "long"), ("many", "int"), ("place", "int"))
    last = nodes.sparkSession.sparkContext.broadcast(shared_by_many(nodes, size))

    def first_shingles(ids, packed):
        named, in_texts = last.value
        out = []
        for node, hashes in zip(ids, _hashes_of(packed, size), strict=True):
            if len(named):
                at = np.minimum(np.searchsorted(named, hashes), len(named) - 1)
                shared = np.where(named[at] == hashes, in_texts[at], 0)
                hashes = hashes[np.argsort(shared, kind="stable")]
            n = prefix_size(len(hashes), least)
            out.append((hashes[:n].view(np.int64), np.full(n, node), np.full(n, len(hashes), np.int32), np.arange(n, dtype=np.int32)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    posts = map_slices(nodes.select("node", "packed"), first_shingles, fields)
    meeting = store(_of_several(posts, "node").drop("n"), "meeting")
    named = meeting.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = store(_of_several(named, "root"), "apart")
    discard(meeting)
    crowd = apart.where(F.col("n") > CROWD).select("node", "root").distinct()
    met = _met(apart.where(F.col("n") <= CROWD), "many", ["node", "root", "many", "place"], least)
    pair = met.groupBy("node_a", "node_b").agg(
        F.count(F.lit(1)).alias("n"), F.max("many_a").alias("many_a"), F.max("many_b").alias("many_b"), F.max("needed").alias("needed")
    )
    # Of the two, take the one whose first shingles end earlier in the order: any of them that the other text has is among the
    # other's first ones, so counted here, and what else they share is not among its first ones. Two of the crowd may also have met
    # elsewhere, but their pairs are all found in the crowd.
    rest = F.greatest(*[F.greatest(F.ceil(least * F.col(x) - 1e-9) - 1, F.lit(0)) for x in ("many_a", "many_b")])
    few = pair.where(F.col("n") + rest >= F.col("needed")).select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    return few.union(_in_crowds(nodes, crowd, size, least)).distinct()


def groups(documents: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, tie (hash of the text) and group of every document.

    Documents of the same words in a row are in one group, and those of different words that links
    hold together; ``group`` is a number without meaning of its own. A null text has no words. Repeated rows and null
    ids are rows like any other; other columns are not read. ``least`` is above 0.
    """
    all_rows = store(described(documents), "described")
    distinct = all_rows.groupBy("s1", "s2").agg(F.first("print").alias("print"), F.first("packed").alias("packed"))
    # Numbers are settled by being written.
    nodes = store(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = store(all_rows.select("doc_id", "tie", "s1", "s2"), "rows")
    discard(all_rows)
    found = stars(checked(store(candidates(nodes), "pairs"), nodes, size, least))
    rest = checked(store(missed(nodes, found, size, least), "missed"), nodes, size, least)
    roots = stars(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    named = nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("group"))
    return skew.left_join(rows, named, ["s1", "s2"]).select("doc_id", "tie", "group")


def one_of_each(documents: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The table with one document of each group: the one of the smallest doc_id.

    Ids that are null come last. Among rows of one id the smallest text hash wins, among equal rows
    any one. All columns stay.
    """
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "tie").alias("place")
    kept = groups(documents, size, least).groupBy("group").agg(F.min(place).alias("place")).select("place.doc_id", "place.tie")
    as_key = lambda id_, tie: F.struct(F.coalesce(id_.cast("string"), F.lit("")), tie.alias("tie"))
    keys = kept.select(as_key(F.col("doc_id"), F.col("tie")).alias("key")).distinct()
    packed = documents.select(
        F.struct("*").alias("row"), as_key(F.col("doc_id").cast("long"), F.xxhash64(whole())).alias("key")
    )
    return packed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")

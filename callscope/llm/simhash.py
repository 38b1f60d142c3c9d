"""SimHash fingerprints and their groups, found in a hierarchical index in Gray order.

Two fingerprints that differ in at most two bits agree in six of their eight bytes. For each of
the 28 choices of six bytes the fingerprint is written with the chosen (masked) bytes first and
replaced by its rank in the Gray code. A rank's leading bits depend on the code's leading bits
alone, so sorting by rank puts fingerprints with a shared masked pattern side by side: the
pattern is the upper node of a tree, the four remaining half-bytes are its lower levels. Pairs of
nodes are descended together, each with the differences accumulated so far, and a pair of whole
groups is dropped as soon as it has more than two.

A masked pattern is shared by at most 2^16 different fingerprints, each with at most 136 others
within two bits, so work per pattern is bounded however many copies a document has. Only a
spanning set of links leaves a pattern; components are joined up from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, map_slices, prepare, schema_of, store, whole
from callscope.llm.components import stars

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: The eight bytes in order for each choice of six: masked bytes first, then the two free ones.
ORDERS = [(*chosen, *sorted({*range(8)} - {*chosen})) for chosen in combinations(range(8), 6)]
FREE_BITS = 16
PAIRS_AT_ONCE = 1 << 20

_BITS = np.array([bin(x).count("1") for x in range(16)], np.uint8)


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint, unsigned; zero for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only 20 and 09-0D split
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and tie (a hash of the text)."""

    def of_slice(doc_ids, texts, ties):
        found = np.array([fingerprint(text) for text in texts], np.uint64).astype(np.int64)
        return [doc_ids, found, ties]

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.xxhash64(whole()).alias("tie")
    )
    return map_slices(rows, of_slice, (("doc_id", "long"), ("fp", "long"), ("tie", "long")))


def gray_ranks(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


def arranged(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """Codes with their bytes in the given order, first byte highest."""
    data = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(data[:, list(order)]).view(">u8").reshape(-1).astype(np.uint64)


def restored(codes: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    return arranged(codes, tuple(int(x) for x in np.argsort(order)))


def descend(codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one group whose free bits differ in at most DISTANCE places.

    ``codes`` holds the free bits; rows of a group and of each prefix are adjacent.
    """
    left, right, gone = np.arange(0), np.arange(0), np.arange(0)
    n = len(codes)
    nodes = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))  # first row of each node
    left = right = np.arange(len(nodes))
    gone = np.zeros(len(nodes), np.uint8)
    for level in range(3, -1, -1):
        prefix = codes >> np.uint64(4 * level)
        fresh = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (groups[1:] != groups[:-1])])
        children = np.flatnonzero(fresh)
        digit = (prefix[children] & np.uint64(15)).astype(np.uint8)
        first = np.searchsorted(children, nodes)
        many = np.diff(np.append(first, len(children)))
        sizes = many[left] * many[right]
        out = []
        edges = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS_AT_ONCE, sizes.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        start = 0
        for stop in np.unique(np.append(edges + 1, len(sizes)).clip(max=len(sizes))):
            a, b, d, size = left[start:stop], right[start:stop], gone[start:stop], sizes[start:stop]
            start = stop
            which = np.repeat(np.arange(len(a)), size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x, y = first[a][which] + place // many[b][which], first[b][which] + place % many[b][which]
            total = d[which] + _BITS[digit[x] ^ digit[y]]
            keep = (total <= DISTANCE) & (x <= y)
            out.append((x[keep], y[keep], total[keep]))
        left, right, gone = (np.concatenate(parts) for parts in zip(*out, strict=True))
        nodes = children
    pair = left < right
    assert len(nodes) == n
    return left[pair], right[pair]


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the given pairs."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[left], labels[right])
        after = labels.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, labels[left], low)
        np.minimum.at(after, labels[right], low)
        after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after


def _links_of(combos: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links inside masked patterns; rows are sorted by (combo, rank)."""
    codes = ranks ^ (ranks >> np.uint64(1))
    masked = codes >> np.uint64(FREE_BITS)
    same = (combos[1:] == combos[:-1]) & (masked[1:] == masked[:-1])
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    combos, codes = combos[keep], codes[keep]
    masked = codes >> np.uint64(FREE_BITS)
    fresh = np.concatenate([[True], (combos[1:] != combos[:-1]) | (masked[1:] != masked[:-1])])
    free = codes & np.uint64((1 << FREE_BITS) - 1)
    labels = spanning(len(codes), *descend(free, np.cumsum(fresh)))
    member = np.flatnonzero(labels != np.arange(len(codes)))
    values = np.zeros(len(codes), np.uint64)
    for combo in np.unique(combos):
        own = combos == combo
        values[own] = restored(codes[own], ORDERS[combo])
    return values[member].astype(np.int64), values[labels[member]].astype(np.int64)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that span the graph of fingerprints ``fp`` within DISTANCE bits of each other."""
    ranked, edge = (("combo", "int"), ("rank", "long")), (("a", "long"), ("b", "long"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for combo, order in enumerate(ORDERS):
                ranks = gray_ranks(arranged(values, order)).astype(np.int64)
                yield batch_of(ranked, [np.full(len(ranks), combo, np.int32), ranks])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combos, ranks = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        for batch in batches:
            combos = np.concatenate([combos, batch.column(0).to_numpy()])
            ranks = np.concatenate([ranks, batch.column(1).to_numpy().astype(np.uint64)])
            if not len(ranks):
                continue
            top = ranks >> np.uint64(FREE_BITS)
            # The last pattern may go on in the next batch.
            last = np.flatnonzero((combos != combos[-1]) | (top != top[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield batch_of(edge, _links_of(combos[:cut], ranks[:cut]))
                combos, ranks = combos[cut:], ranks[cut:]
        if len(ranks):
            yield batch_of(edge, _links_of(combos, ranks))

    prepare(distinct.sparkSession)
    rows = distinct.select("fp").mapInArrow(rank, schema_of(ranked))
    # Signed order within a pattern is still Gray order, as only the highest bit is turned.
    rows = rows.withColumn("pattern", F.shiftright("rank", FREE_BITS)).repartition("combo", "pattern")
    return rows.sortWithinPartitions("combo", "rank").select("combo", "rank").mapInArrow(search, schema_of(edge))


def grouped(prints: DataFrame) -> DataFrame:
    """doc_id, fp, tie and component_id for a stored table of fingerprints."""
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = stars(links(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "root").select(F.col("fp").alias("print"), "component_id")
    return prints.join(of_print, prints.fp == of_print.print, "left").select("doc_id", "fp", "tie", "component_id")


def simhash(documents: DataFrame) -> DataFrame:
    """Fingerprint and component of every document.

    A null text has no words and the fingerprint zero. Repeated rows are rows of their own with
    the same component. A null doc_id takes part in links; the component's id is the smallest id
    that is not null, or null if there is none. Other columns are not read.
    """
    prints = store(fingerprints(documents), "prints")
    return grouped(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The table with one document of each component: the one of the smallest doc_id.

    Among rows of that id the smallest text hash wins, among equal rows any one. All columns stay.
    """
    prints = store(fingerprints(documents), "prints")
    known, order = grouped(prints), F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    winner = known.withColumn("place", order).groupBy("component_id").agg(F.min("place").alias("place"))
    # Without any id each component would be one: null components are told apart by fingerprint.
    winner = winner.where("component_id IS NOT NULL").select("place.*")
    lone = known.where("component_id IS NULL").groupBy("fp").agg(F.min("tie").alias("tie"))
    winner = winner.select("doc_id", "tie").union(lone.select(F.lit(None).cast("long").alias("doc_id"), "tie"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie"))
    keys = winner.select(key.alias("key")).distinct()
    packed = documents.select(
        F.struct("*").alias("row"),
        F.struct(
            F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.xxhash64(whole()).alias("tie")
        ).alias("key"),
    )
    kept = packed.join(keys, "key", "left_semi").dropDuplicates(["key"])
    return kept.select("row.*")

"""Removal of every byte inside a 400-byte string that also starts somewhere else.

Sorting all suffixes would ship hundreds of bytes for each byte of text. Which suffixes can have a
twin is found first, with fingerprints alone, and only the rest is sorted and merged:

1. Anchors. Every 400-byte window has an anchor: the leftmost 200-byte piece of least hash inside
   it. Equal windows have equal anchors at equal places. Windows of one anchor form a segment of
   at most 201 windows. An anchor seen once has no twins and goes; so far hashes are a filter.
2. Cells. Different segments of one anchor are cut into cells of 16 windows, aligned to the
   anchor; cells whose shared part occurs once go too.
3. Suffix runs. What is left are keys of 32 bytes that begin with the anchor: a whole segment and a whole
   cell by 128 bits of its content each, and, where cells of one shared part differ, each window by its group
   (the 385 inner bytes) and the 15 bytes around. Tasks sort their keys into front-coded
   runs, runs are exchanged by ranges of keys and merged by loser trees that carry common prefix
   lengths; a key that occurs twice is a twin. Nothing is removed that the merge has not found twice.

Ranges hold a counted number of keys at most; one of very many keys is dealt to several parts. Every count is an
aggregate with map-side sums, and ranges return to documents by equi joins on keys that Spark can split when they
are hot; no group of equal strings is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, map_slices, prepare, schema_of, slices, store, whole
from callscope.llm.suffix_runs import front_coded, merged

SPAN = 400
PIECE = 200
WINDOWS = SPAN - PIECE + 1
CELL = 16
#: Windows hashed at a time; a longer text goes through in parts.
PART = 1 << 20
#: A key: anchor, content or group, what it is, and more content or the bytes around.
KEY = 8 + 8 + 1 + CELL - 1
SEGMENT_TAG, CELL_TAG = 255, 254
#: Ranges of anchors that are counted, fewest parts, and keys that a part may have.
RANGES = 4096
LEAST_PARTS = 64
PART_KEYS = 1_000_000
#: Keys that a task sorts at a time.
RUN_KEYS = 200_000

_FACTOR = 0x9E3779B97F4A7C15
_TABLES: list[tuple[np.ndarray, ...]] = []


def tables() -> tuple[np.ndarray, ...]:
    """Two rows of random numbers for bytes, powers of the factor, and powers of its inverse modulo 2^64."""
    if not _TABLES:
        n = PART + SPAN
        powers, inverse = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        of_byte, other = (np.random.default_rng(k).integers(0, 1 << 64, 256, np.uint64) for k in (7, 8))
        _TABLES.append((of_byte, other, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)))
    return _TABLES[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value of each window of ``width`` values."""
    n = len(values) - width + 1
    pad = (-len(values)) % width
    rows = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    places = np.arange(rows.size, dtype=np.int64).reshape(rows.shape)
    ahead = np.minimum.accumulate(rows, axis=1)
    better = np.ones(rows.shape, bool)
    better[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(better, places, 0), axis=1)
    turned = rows[:, ::-1]
    back = np.minimum.accumulate(turned, axis=1)
    step = np.arange(width)
    last = np.maximum.accumulate(np.where(turned == back, step, 0), axis=1)[:, ::-1]
    back_at = places[:, :1] + (width - 1 - last)
    back = back[:, ::-1].ravel()[:n]
    tail = ahead.ravel()[width - 1 : width - 1 + n]
    return np.where(back <= tail, back_at.ravel()[:n], ahead_at.ravel()[width - 1 : width - 1 + n])


def anchors(data: bytes) -> list[np.ndarray]:
    """h, seg, start, windows, inset (anchor minus start) of each segment of a text."""
    h, seg, _, start, n, inset = described(data)
    return [h, seg, start, n, inset]


def described(data: bytes) -> list[np.ndarray]:
    """``anchors`` with a second hash of the content behind the first: h, seg, seg2, start, windows, inset (anchor minus start) of each segment of a text."""
    out = [[np.zeros(0, kind)] for kind in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    of_byte, other, powers, inverse = tables()
    total = len(data) - SPAN + 1
    whole_text = np.frombuffer(data, np.uint8)
    for at in range(0, max(total, 0), PART):
        own = whole_text[at : min(at + PART, total) + SPAN - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(of_byte[own] * powers[: len(own)], out=sums[1:])
        n = len(own) - PIECE + 1
        hashes = mixed((sums[PIECE:] - sums[:n]) * inverse[:n])
        where = leftmost_least(hashes, WINDOWS)
        start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        count = np.diff(np.append(start, len(where)))
        content = (sums[start + count + SPAN - 1] - sums[start]) * inverse[start]
        anchor = hashes[where[start]]
        np.cumsum(other[own] * powers[: len(own)], out=sums[1:])
        more = (sums[start + count + SPAN - 1] - sums[start]) * inverse[start]
        sized = count.astype(np.uint64)
        found = anchor, mixed(content + sized), mixed(more + sized), start + at, count, where[start] - start
        for column, values in zip(out, found, strict=True):
            column.append(values)
    return [np.concatenate(column) for column in out]


SEGMENTS = (
    ("rid", "long"),
    ("h", "long"),
    ("seg", "long"),
    ("seg2", "long"),
    ("start", "long"),
    ("n", "int"),
    ("inset", "int"),
)
REPS = (("h", "long"), ("seg", "long"), ("times", "long"), ("n", "int"), ("inset", "int"), ("text", "binary"))
CELLS = (
    ("h", "long"),
    ("core", "long"),
    ("full", "long"),
    ("seg", "long"),
    ("single", "boolean"),
    ("low", "int"),
    ("high", "int"),
    ("around", "binary"),
)


def segments(rows: DataFrame) -> DataFrame:
    """The segments of all texts; ``rows`` has rid and the packed text."""

    def of_slice(rids, texts):
        found = [described(unpacked(text)) for text in texts]
        columns = [np.concatenate(column) for column in zip(*found, strict=True)]
        counts = [len(x[0]) for x in found]
        h, seg, seg2, start, n, inset = columns
        return [
            np.repeat(np.array(rids, np.int64), counts),
            h.astype(np.int64),
            seg.astype(np.int64),
            seg2.astype(np.int64),
            start,
            n.astype(np.int32),
            inset.astype(np.int32),
        ]

    return map_slices(rows, of_slice, SEGMENTS, 64)


def settled(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows whose key occurs more than once, with ``mixed``: whether their contents differ.

    The counts are stored first. The join then stands on two plain shuffles, of which Spark splits
    the partitions of a hot key; over an aggregate it could not.
    """
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.min(content).alias("least"), F.max(content).alias("most")
    )
    counted = counted.where("occurrences > 1").select(*keys, (F.col("least") != F.col("most")).alias("mixed"))
    return rows.join(store(counted, "counts"), keys)


def packed_texts(rows: DataFrame) -> DataFrame:
    """rid, doc_id and the compressed text, ready to be shuffled."""

    def of_slice(rids, ids, texts):
        pack = zstandard.ZstdCompressor(level=1).compress
        return [rids, ids, [pack(text.encode()) for text in texts]]

    return map_slices(rows, of_slice, (("rid", "long"), ("doc_id", "long"), ("packed", "binary")))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def cells_of(segment: tuple) -> Iterator[tuple]:
    """The cells of a segment; offsets count back from the anchor to the window's start."""
    h, seg, times, n, inset, text = segment
    least, most = inset - n + 1, inset
    for cell in range(least // CELL, most // CELL + 1):
        base = inset - CELL * cell  # start of the window of the cell's least offset
        low, high = max(least, CELL * cell), min(most, CELL * cell + CELL - 1)
        core = xxhash.xxh3_64_intdigest(text[base : base - CELL + 1 + SPAN]) - (1 << 63)
        content = text[inset - high : inset - low + SPAN]
        full = xxhash.xxh3_64_intdigest(content, low * 256 + high) - (1 << 63)
        # The 15 bytes before and after the part shared by all windows, as far as the segment goes.
        before = text[max(0, base - CELL + 1) : base].rjust(CELL - 1, b"\0")
        after = text[base - CELL + 1 + SPAN : base + SPAN].ljust(CELL - 1, b"\0")
        yield h, core, full, seg, times == 1, low, high, before + after


def keys_of(h: int, core: int, low: int, high: int, around: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, key) of each window of a cell."""
    head, base = h.to_bytes(8, "big", signed=True) + core.to_bytes(8, "big", signed=True), low // CELL * CELL
    for offset in range(low, high + 1):
        k = offset - base
        yield offset, head + bytes((k,)) + around[CELL - 1 - k : 2 * CELL - 2 - k]


def _eight(value: int) -> bytes:
    """A signed number so that bytes are in the order of the unsigned one."""
    return value.to_bytes(8, "big", signed=True)


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def content_key(h: int, content: int, tag: int, more: int) -> bytes:
    return _eight(h) + _eight(content) + bytes((tag,)) + _eight(more) + bytes(KEY - 25)


#: What becomes keys: segments and cells have low null, windows of a cell have their offsets and bytes around.
SOURCES = "h bigint, a bigint, tag int, b bigint, low int, high int, around binary"


def part_table(sources: DataFrame) -> tuple[list[int], list[int]]:
    """First part and number of parts of each range of anchors, from the counted keys in it.

    Counts and numbers are at most ``RANGES`` rows, whatever the data.
    """
    many = F.coalesce(F.col("high") - F.col("low") + 1, F.lit(1))
    spread = sources.groupBy(range_of(F.col("h")).alias("r")).agg(F.sum(many).alias("keys"))
    counts = {r["r"]: r["keys"] for r in spread.collect()}
    size = max(1, min(PART_KEYS, sum(counts.values()) // LEAST_PARTS))
    first, parts, at, room = [], [], 0, 0
    for r in range(RANGES):
        keys = counts.get(r, 0)
        own = -(-keys // PART_KEYS) if keys > PART_KEYS else 1
        if own > 1 or room + keys > size:  # a full range, or one that no longer fits, begins a new part
            at, room = at + (room > 0), 0
        first.append(at)
        parts.append(own)
        room += keys
        if own > 1:
            at, room = at + own, 0
    return first, parts


def range_of(h: F.Column) -> F.Column:
    """The range of an anchor, by its leading bits as they stand in keys."""
    return F.shiftrightunsigned(h, 64 - (RANGES - 1).bit_length()).cast("int")


def runs_of(sources: DataFrame) -> DataFrame:
    """Front-coded runs of keys: one for each part of the key space and ``RUN_KEYS`` keys of a task."""
    first, parts = part_table(sources)
    shift = 8 - (RANGES - 1).bit_length() + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[bytes, int]] = {}
        held = 0

        def sorted_runs() -> pa.RecordBatch:
            runs = [front_coded(x) for x in found.values()]
            return batch_of((("part", "int"), ("run", "binary")), [list(found), runs])

        for columns in slices(batches):
            for h, a, tag, b, low, high, around in zip(*columns, strict=True):
                keys = [content_key(h, a, tag, b)] if low is None else [k for _, k in keys_of(h, a, low, high, around)]
                at = int.from_bytes(_eight(h)[:2], "big") >> shift
                held += len(keys)
                for key in keys:
                    part = first[at]
                    if parts[at] > 1:
                        part += xxhash.xxh3_64_intdigest(key) % parts[at]
                    own = found.setdefault(part, {})
                    own[key] = own.get(key, 0) + 1
            if held >= RUN_KEYS:
                yield sorted_runs()
                found, held = {}, 0
        yield sorted_runs()

    prepare(sources.sparkSession)
    return sources.select("h", "a", "tag", "b", "low", "high", "around").mapInArrow(run, "part int, run binary")


TWINS = (("tag", "int"), ("h", "long"), ("a", "long"), ("b", "long"), ("key", "binary"))


def twin_keys(runs: DataFrame) -> DataFrame:
    """The keys that occur more than once over all runs, whole and in their fields; a part's runs are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_part(own):
            found = [key for key, times in merged(own, KEY) if times > 1]
            columns = [[k[16] for k in found], *[[_number(k[i : i + 8]) for k in found] for i in (0, 8, 17)], found]
            return batch_of(TWINS, columns)

        now, own = None, []
        for parts, data in slices(batches):
            for part, value in zip(parts, data, strict=True):
                if part != now:
                    if own:
                        yield of_part(own)
                    now, own = part, []
                own.append(value)
        if own:
            yield of_part(own)

    dealt = runs.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, schema_of(TWINS))


def twin_ranges(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed texts, stored ranges): rid, and first and last start of windows that have a twin."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")
    )
    texts = store(packed_texts(rows), "texts")  # which settles the numbers
    found = store(settled(segments(texts.select("rid", "packed")), ["h"], "seg"), "segments")

    # One place of each different segment; its text is cut out of the document there.
    unclear = found.where("mixed")
    place = F.struct("rid", "start", "n", "inset")
    different = unclear.groupBy("h", "seg").agg(F.count("*").alias("times"), F.min(place).alias("place"))
    wanted = different.groupBy("place.rid").agg(
        F.collect_list(F.struct("h", "seg", "times", "place.n", "place.inset", "place.start")).alias("wanted")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, lists in slices(batches, 64):
            out = []
            for packed, places in zip(data, lists, strict=True):
                text = unpacked(packed)
                for x in places:
                    piece = text[x["start"] : x["start"] + x["n"] + SPAN - 1]
                    out.append((x["h"], x["seg"], x["times"], x["n"], x["inset"], piece))
            yield batch_of(REPS, list(zip(*out, strict=True)) or [[] for _ in REPS])

    pieces = texts.join(wanted, "rid").select("packed", "wanted").mapInArrow(cut, schema_of(REPS))

    def cells(columns: DataFrame) -> DataFrame:
        def of_slice(*values):
            out = [cell for row in zip(*values, strict=True) for cell in cells_of(row)]
            return list(zip(*out, strict=True)) or [[] for _ in CELLS]

        return map_slices(columns, of_slice, CELLS)

    cut_cells = store(cells(pieces), "cut")
    shared = store(settled(cut_cells, ["h", "core"], "full"), "cells")
    edges, equal = shared.where("mixed"), shared.where("NOT mixed")
    none = lambda kind: F.lit(None).cast(kind)
    as_key = lambda rows, a, tag, b: rows.select(
        "h", F.col(a).alias("a"), F.lit(tag).alias("tag"), F.col(b).alias("b"),
        none("int").alias("low"), none("int").alias("high"), none("binary").alias("around"),
    )
    inner = edges.select(
        "h", F.col("core").alias("a"), F.lit(0).alias("tag"), none("long").alias("b"), "low", "high", "around"
    )
    sources = as_key(found, "seg", SEGMENT_TAG, "seg2").union(as_key(equal, "core", CELL_TAG, "full")).union(inner)
    twins = store(twin_keys(runs_of(sources)), "twins")

    segment = twins.where(F.col("tag") == SEGMENT_TAG).select("h", F.col("a").alias("seg"), F.col("b").alias("seg2"))
    clear = found.join(segment, ["h", "seg", "seg2"]).select(
        "rid", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")
    )
    cell = twins.where(F.col("tag") == CELL_TAG).select("h", F.col("a").alias("core"), F.col("b").alias("full"))
    cell = equal.where("single").join(cell, ["h", "core", "full"]).select("h", "seg", "low", "high")

    def keyed(h, seg, core, low, high, around):
        out = [
            (a, b, offset, key)
            for a, b, *rest in zip(h, seg, core, low, high, around, strict=True)
            for offset, key in keys_of(a, *rest)
        ]
        return list(zip(*out, strict=True)) or [[], [], [], []]

    fields = (("h", "long"), ("seg", "long"), ("offset", "int"), ("key", "binary"))
    windows = map_slices(edges.where("single").select("h", "seg", "core", "low", "high", "around"), keyed, fields)
    window = windows.join(twins.where(F.col("tag") < CELL).select("key"), "key")
    ranges = cell.union(window.select("h", "seg", F.col("offset").alias("low"), F.col("offset").alias("high")))
    back = unclear.select("h", "seg", "rid", (F.col("start") + F.col("inset")).alias("anchor")).join(ranges, ["h", "seg"])
    back = back.select("rid", (F.col("anchor") - F.col("high")).alias("first"), (F.col("anchor") - F.col("low")).alias("last"))
    return texts, store(clear.union(back), "ranges")


FIELDS = (
    ("doc_id", "long"),
    ("n_bytes", "long"),
    ("n_removed", "long"),
    ("n_spans", "long"),
    ("kept_sha256", "string"),
)


def covered(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes inside the windows of the given ranges of starts."""
    runs: list[tuple[int, int]] = []
    for start, end in sorted(zip(first, last, strict=True)):
        end += SPAN
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def dedup(documents: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs and hash of the rest for every document.

    A null text is empty. Repeated rows are twins of each other. Texts are read as UTF-8; what
    stays need not be valid UTF-8. A null doc_id is kept; other columns are not read.
    """
    texts, ranges = twin_ranges(documents)
    of_text = ranges.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    found = texts.join(of_text, "rid", "left").select("doc_id", "packed", "ranges.first", "ranges.last")

    def of_slice(ids, data, first, last):
        out = [[] for _ in FIELDS]
        for doc_id, packed, a, b in zip(ids, data, first, last, strict=True):
            text = unpacked(packed)
            runs, at, kept = covered(a or [], b or []), 0, hashlib.sha256()
            for start, end in runs:
                kept.update(text[at:start])
                at = end
            kept.update(text[at:])
            row = doc_id, len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest()
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return map_slices(found, of_slice, FIELDS, 64)

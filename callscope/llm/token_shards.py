"""Training-order materialisation: token sequences in a keyed random order, in binary shards.

Documents are tokenised once and cut into sequences of a fixed number of tokens. The order is a
keyed bijection of two digits, so that each sequence crosses the network once: a keyed hash of
its identity - doc_id, text, part, and a number of its own among equal rows - picks the shard; inside the shard a keyed Feistel network over the shard's
sequences, cycle-walked to their exact number, assigns the place. A sequence's global slot is the
number of sequences in the shards before plus its place; slots are 0, 1, 2, ... without gaps and
do not depend on the layout of the input, on retries or on the number of executors.

Spark's own file writer commits the shards, one file each: records of one stride, in slot order,
so a reader resumes at slot s by seeking to (s - first slot) * stride. A record is doc_id, part
and token count (little endian, 8 + 4 + 4 bytes), the token ids as unsigned 16-bit numbers, filled
up with the end id, and one line feed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, prepare, schema_of, slices, store, whole
from callscope.session import shared_folder

SEQUENCE = 512
#: Bytes of records that a shard may have, and the fewest shards; a worker holds one shard at a time.
SHARD_BYTES = 256 << 20
LEAST_SHARDS = 64
END = 50256
ROUNDS = 6
NO_ID = -(1 << 63)
HEADER = 16

_TOKENIZERS: dict[tuple[str, str], object] = {}


def tokenizer(path: str, pattern: str):
    """One tokenizer per worker process for a file of ranks."""
    if (path, pattern) not in _TOKENIZERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _TOKENIZERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path, pattern]


def mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers."""
    x = values.astype(np.uint64) ^ np.uint64(key & (1 << 64) - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def round_keys(key: int, *more: int) -> list[int]:
    """Independent keys for the rounds of one network."""
    seed = ",".join(map(str, (key, *more))).encode()
    return [int.from_bytes(hashlib.blake2b(seed, digest_size=8, salt=bytes([k])).digest(), "little") for k in range(ROUNDS)]


def permuted(n: int, keys: list[int]) -> np.ndarray:
    """The image of 0 .. n-1 under a Feistel network on the next even number of bits, walked until below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def network(x):
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            left, right = right, left ^ (mixed(right, key) & low)
        return left << np.uint64(half) | right

    out = network(np.arange(n, dtype=np.uint64))
    while (outside := out >= n).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


PIECES = (
    ("shard", "int"),
    ("doc_id", "long"),
    ("tie", "long"),
    ("part", "int"),
    ("n_tokens", "int"),
    ("tokens", "binary"),
)
RECORDS = (("shard", "int"), ("record", "binary"))


def pieces(documents: DataFrame, path: str, pattern: str, shards: int, key: int, size: int = SEQUENCE) -> DataFrame:
    """Sequences with their shard; a document ends with END, so an empty one is a sequence too."""
    salt = round_keys(key, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_to_numpy
        for ids, ties, copies, texts in slices(batches):
            out = [[] for _ in PIECES]
            for doc_id, tie, copy, text in zip(ids, ties, copies, texts, strict=True):
                tokens = np.append(encode(text, disallowed_special=()), END).astype("<u2")
                doc_id = NO_ID if doc_id is None else doc_id
                many = -(-len(tokens) // size)
                own = mixed(np.arange(many), int(mixed(np.array([doc_id]), salt[0])[0]) ^ tie)
                if copy:
                    own = mixed(own, salt[2] + copy)
                data = tokens.tobytes()
                out[0] += (mixed(own, salt[1]) % np.uint64(shards)).tolist()
                out[1] += [doc_id] * many
                out[2] += [tie] * many
                out[3] += range(many)
                out[4] += [min(size, len(tokens) - at) for at in range(0, len(tokens), size)]
                out[5] += [data[2 * at : 2 * (at + size)] for at in range(0, len(tokens), size)]
            yield batch_of(PIECES, out)

    prepare(documents.sparkSession)
    return told_apart(documents).select("doc_id", "tie", "copy", "text").mapInArrow(run, schema_of(PIECES))


def told_apart(documents: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), text, and copy: 0, 1, 2, ... among equal rows.

    Equal rows are few or are one text very many times. Each such text is taken out once with the number of
    its rows, and repeated with their numbers; the other rows stay where they are.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("tie"), whole().alias("text")
    )
    # The id as text that is never null: rows without an id can be equal too.
    keyed = rows.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Stored, so that Spark knows that they are few and leaves the texts where they are.
    again = store(keyed.groupBy("name", "tie").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "again")
    lone = keyed.join(again, ["name", "tie"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    one = keyed.join(again.select("name", "tie"), ["name", "tie"], "left_semi").groupBy("name", "tie").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text")
    )
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("copy")
    repeated = one.join(again, ["name", "tie"]).select("doc_id", "tie", "text", numbers)
    return lone.select("doc_id", "tie", "text", "copy").union(repeated.select("doc_id", "tie", "text", "copy"))


def records(sequences: DataFrame, shards: int, key: int, size: int = SEQUENCE) -> DataFrame:
    """Records of each shard in order of place; ``sequences`` are sorted inside their shard."""
    filled = np.full(size, END, "<u2").tobytes()

    def of_shard(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        place = permuted(len(rows), round_keys(key, shard))
        order = np.argsort(place)
        for at in range(0, len(rows), 4096):
            chosen = [rows[k] for k in order[at : at + 4096].tolist()]
            heads = np.array([(d, p, n) for d, p, n, _ in chosen], [("d", "<i8"), ("p", "<i4"), ("n", "<i4")]).tobytes()
            yield batch_of(
                RECORDS,
                [
                    [shard] * len(chosen),
                    [heads[HEADER * k : HEADER * (k + 1)] + x[3] + filled[len(x[3]) :] for k, x in enumerate(chosen)],
                ],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for names, ids, _, parts, counts, data in slices(batches, 4096):
            for shard, *row in zip(names, ids, parts, counts, data, strict=True):
                if shard != now:
                    if rows:
                        yield from of_shard(now, rows)
                    now, rows = shard, []
                rows.append(tuple(row))
        if rows:
            yield from of_shard(now, rows)

    dealt = sequences.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "part")
    return dealt.mapInArrow(run, schema_of(RECORDS))


def write_shards(
    documents: DataFrame, folder: str, path: str, pattern: str, *, key: int = 1, size: int = SEQUENCE
) -> int:
    """Write ``documents`` as shards below ``folder`` and return their number.

    Files are folder/shard=K/part-*. A null text is empty. Repeated rows are sequences of their
    own; a null doc_id is written as the least 64-bit number. Other columns are not read.
    """
    # A token is a byte or more, and every text has an end: so many records at most.
    records_of = F.floor(F.octet_length(whole()) / size) + 1
    total = documents.agg(F.sum(records_of)).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total * (HEADER + 2 * size + 1) // SHARD_BYTES))
    made = records(pieces(documents, path, pattern, shards, key, size), shards, key, size)
    # A cast from binary to string keeps the bytes as they are; the writer adds the line feed.
    rows = made.select("shard", F.col("record").cast("string").alias("value"))
    rows.write.partitionBy("shard").option("compression", "none").text(folder)
    return shards


INDEX = (
    ("shard", "int"),
    ("place", "long"),
    ("doc_id", "long"),
    ("part", "int"),
    ("n_tokens", "int"),
    ("tokens_sha256", "string"),
)


def read_records(data: bytes, size: int = SEQUENCE, start: int = 0) -> Iterator[tuple]:
    """(doc_id, part, ids as bytes) of a shard's records from a given place on."""
    stride = HEADER + 2 * size + 1
    for at in range(start * stride, len(data), stride):
        doc_id, part, n = np.frombuffer(data, [("d", "<i8"), ("p", "<i4"), ("n", "<i4")], 1, at)[0].tolist()
        yield (None if doc_id == NO_ID else doc_id), part, data[at + HEADER : at + HEADER + 2 * n]


def read_index(spark: SparkSession, folder: str, size: int = SEQUENCE) -> DataFrame:
    """One row per record of written shards: slot, shard, place, doc_id, part, n_tokens, tokens_sha256.

    The hash is over the token ids as they stand in the record, without what fills it up. Slots are counted from the files' sizes.
    """
    stride = HEADER + 2 * size + 1
    number = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard")
    # One row per shard, which is what the running sum needs in one place.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sizes = files.select(number, (F.col("length") / stride).cast("long").alias("n"))
    sizes = dict(sizes.groupBy("shard").agg(F.sum("n")).collect())
    first, at = {}, 0
    for shard in sorted(sizes):
        first[shard], at = at, at + sizes[shard]
    fields = (("slot", "long"), *INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, contents in slices(batches, 1):
            for shard, data in zip(shards, contents, strict=True):
                rows = []
                for place, (doc_id, part, ids) in enumerate(read_records(data, size)):
                    digest = hashlib.sha256(ids).hexdigest()
                    rows.append((first[shard] + place, shard, place, doc_id, part, len(ids) // 2, digest))
                yield batch_of(fields, list(zip(*rows, strict=True)) or [[] for _ in fields])

    prepare(spark)
    return files.select(number, "content").mapInArrow(run, schema_of(fields))


def materialise(documents: DataFrame, path: str, pattern: str, *, key: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Write shards into a new folder of the shared folder and return their index."""
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(documents, folder, path, pattern, key=key, size=size)
    return read_index(spark, folder, size)

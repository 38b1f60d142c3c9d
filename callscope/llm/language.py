"""Language identification as a mixture of languages inferred for each document.

Letter trigrams (with word edges) are counted per language over all training documents in Spark;
smoothed, they give every word a likelihood under each language. A document is a mixture: expec-
tation-maximisation over its words estimates the languages' proportions. Sets of languages grow
from the single best one; a larger set must raise the likelihood by more than a penalty that
grows with the logarithm of the document's words. The prediction is the language of the largest
proportion in the chosen set, the score that proportion.

Trigrams are hashed into ``BUCKETS`` counters, so the model has languages x 65,536 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import batch_of, map_slices, prepare, schema_of, slices, whole

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 15
#: Log likelihood that another language must bring: a constant and a factor of log(words).
PENALTY = (6.0, 1.0)
#: Letters handled at a time; a longer text goes through in pieces cut between words.
PIECE = 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, index of the text of each) of lowered texts, in pieces of bounded size."""
    points, owners, size = [], [], 0
    is_letter = letters()
    for number, text in enumerate(texts):
        own = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        at = 0
        while at < len(own):
            stop = at + PIECE
            if stop < len(own):
                gap = np.flatnonzero(~is_letter[own[at:stop]])
                stop = at + int(gap[-1]) + 1 if len(gap) else stop
            part = own[at:stop]
            points += [part, np.zeros(1, "<u4")]
            owners.append(np.full(len(part) + 1, number, np.int64))
            at, size = stop, size + len(part)
            if size >= PIECE:
                yield np.concatenate(points), np.concatenate(owners)
                points, owners, size = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owners)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of each letter, the letters' places, and the first letter of each word."""
    is_letter = letters()[points]
    plain = np.where(is_letter, points, 0).astype(np.uint32)
    before, after = np.concatenate([[0], plain[:-1]]), np.concatenate([plain[1:], [0]])
    mixed = (
        before.astype(np.uint32) * np.uint32(0x9E3779B1)
        + plain * np.uint32(0x85EBCA77)
        + after.astype(np.uint32) * np.uint32(0xC2B2AE3D)
    )
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    places = np.flatnonzero(is_letter)
    first = np.flatnonzero(np.concatenate([[True], ~is_letter[:-1]])[places])
    return (mixed >> np.uint32(16))[places], places, first


COUNTED = (("lang", "string"), ("bucket", "int"), ("n", "long"))


def count_grams(training: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of (lang, text); each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flushed():
            for lang, total in counts.items():
                found = np.flatnonzero(total)
                yield batch_of(COUNTED, [[lang] * len(found), found.astype(np.int32), total[found]])
            counts.clear()

        for langs, texts in slices(batches):
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for points, owners in pieces(texts):
                found, places, _ = grams(points)
                of_gram = number[owners[places]]
                for k in np.unique(of_gram):
                    total = counts.setdefault(names[k], np.zeros(BUCKETS, np.int64))
                    total += np.bincount(found[of_gram == k], minlength=BUCKETS)
            if len(counts) > 64:
                yield from flushed()
        yield from flushed()

    prepare(training.sparkSession)
    return training.mapInArrow(run, schema_of(COUNTED)).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihood of each trigram bucket in each language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({lang for lang, _, _ in rows})
        counts = np.zeros((BUCKETS, len(self.names)))
        place = {name: k for k, name in enumerate(self.names)}
        for lang, bucket, n in rows:
            counts[bucket, place[lang]] = n
        counts += SMOOTHING
        self.logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word under each language, and the text it belongs to."""
        found, owner = [np.zeros((0, len(self.names)), np.float32)], [np.zeros(0, np.int64)]
        for points, owners in pieces(texts):
            buckets, places, first = grams(points)
            if len(first):
                found.append(np.add.reduceat(self.logs[buckets], first, axis=0))
                owner.append(owners[places[first]])
        return np.concatenate(found), np.concatenate(owner)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        logs, owner = self.words(texts)
        if not len(owner):
            return names, scores
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best, share = infer(logs.astype(np.float64), start)
        for text, k, s in zip(owner[start].tolist(), best.tolist(), share.tolist(), strict=True):
            names[text], scores[text] = self.names[k], s
        return names, scores


def mixture(
    likely: np.ndarray, start: np.ndarray, of_word: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood (beyond the words' maxima) of each document's mixture."""
    n = np.diff(np.append(start, len(likely)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = likely * share[of_word]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(joint, start, axis=0) / n
    total = (likely * share[of_word]).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), start)


def infer(logs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The main language and its proportion for documents whose words begin at ``start``."""
    n = np.diff(np.append(start, len(logs)))
    highest = logs.max(axis=1)
    alone = np.add.reduceat(logs, start, axis=0)
    best, share = alone.argmax(axis=1), np.ones(len(start))
    penalty = PENALTY[0] + PENALTY[1] * np.log(n)
    bound = np.add.reduceat(highest, start)
    value = alone.max(axis=1)
    # No mixture can beat every word at its best language.
    mixed = np.flatnonzero(bound - value > penalty)
    if not len(mixed) or logs.shape[1] < 2:
        return best, share
    rows = np.repeat(np.isin(np.arange(len(start)), mixed), n)
    likely = np.exp(logs[rows] - highest[rows, None])
    sizes = n[mixed]
    begin, of_word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(mixed)), sizes)
    full, _ = mixture(likely, begin, of_word, np.ones((len(mixed), logs.shape[1])))
    order = np.argsort(-full, axis=1)
    place = np.argsort(order, axis=1)
    reached = value[mixed] - bound[mixed]
    open_ = np.ones(len(mixed), bool)
    for size in range(2, logs.shape[1] + 1):
        shares, fit = mixture(likely, begin, of_word, (place < size).astype(float))
        gain = open_ & (fit - (size - 1) * penalty[mixed] > reached)
        reached[gain] = (fit - (size - 1) * penalty[mixed])[gain]
        best[mixed[gain]], share[mixed[gain]] = shares.argmax(axis=1)[gain], shares.max(axis=1)[gain]
        open_ &= gain
        if not open_.any():
            break
    return best, share


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(documents: DataFrame) -> Model:
    """The model of all documents that have a language and are not held out."""
    rows = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counted = count_grams(rows.select(F.col("lang").cast("string").alias("lang"), whole().alias("text")))
    return Model([tuple(row) for row in counted.collect()])  # languages x BUCKETS rows at most


FIELDS = (("doc_id", "long"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"))


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Predicted language of every document.

    A null text, a text without a letter, and any text if no language could be learned give
    ``und`` with score 0. Ties go to the language first in the alphabet. Repeated rows are kept;
    a null doc_id is held out. A prediction reads the text alone.
    """
    model = model or learn(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of_slice(doc_ids, held, texts):
        return [doc_ids, held, *shared.value.predict(texts)]

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), whole().alias("text")
    )
    return map_slices(rows, of_slice, FIELDS)

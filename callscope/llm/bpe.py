"""Byte-pair encoding and decoding with a contiguous array of ranks per word.

A word is a row of parts. Two flat lists hold the parts' ids and the rank of each adjacent pair.
The lowest rank is found by scanning the list, its boundary is deleted and only the two
neighbouring ranks are looked up again. Words are short, so the scan stays inside a cache line
or two; a word of more than ``LONG`` parts goes through a heap of the same (rank, place) order
instead, which gives the same merges without quadratic time.

Words repeat, so each worker keeps two generations of encoded words of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import map_slices, whole

LONG = 200
CACHE_WORDS = 150_000
NONE = 1 << 40

#: White space of the vocabulary's patterns (Unicode property White_Space), fixed values.
SPACE = "\t-\r \x85\xa0  -     　"

FIELDS = (("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(spare)) for byte in range(256)]


class Cache(dict):
    """word -> encoded word; the older of two generations is dropped when the younger is full."""

    def __init__(self, encode, limit=CACHE_WORDS):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class Encoder:
    """A vocabulary of kind "BPE with word ends" read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {number: token for token, number in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({number: token for token, number in self.special.items()})
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        # The same pattern where all letters are ASCII; the standard module is faster.
        ascii_pattern = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", "\t-\r ")
        self.ascii_words = re.compile(ascii_pattern).findall
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.cache = Cache(self.describe)

    def merge(self, ids: list[int]) -> list[int]:
        """The parts of a word after all merges, lowest rank first, leftmost among equals."""
        if len(ids) > LONG:
            return self.merge_long(ids)
        find, made = self.ranks.get, self.made
        ranks = [find(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == NONE:
                break
            i = ranks.index(lowest)
            ids[i] = made[lowest]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = find(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, find, made = len(ids), self.ranks.get, self.made
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), [NONE] * n
        heap = []

        def refresh(i):
            ranks[i] = find(ids[i] << 20 | ids[after[i]], NONE) if after[i] < n else NONE
            if ranks[i] != NONE:
                heapq.heappush(heap, (ranks[i], i))

        for i in range(n - 1):
            refresh(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = made[rank], -1, NONE
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return [x for x in ids if x >= 0]

    def describe(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded word."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        ids = self.merge(ids)
        return len(ids), " ".join(map(str, ids)), " ".join([self.tokens[x] for x in ids])

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, after the vocabulary's normalisation."""
        if text.isascii():
            return self.ascii_words(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Letters are lowered one by one: a sigma at the end of a word has no form of its own.
        return self.words(text.replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """Encoded words and special tokens in order."""
        find = self.cache.__getitem__
        if "<|" not in text:
            return list(map(find, self.split(text)))
        out, at = [], 0
        for match in self.specials.finditer(text):
            out += map(find, self.split(text[at : match.start()]))
            out.append((1, str(self.special[match[0]]), match[0]))
            at = match.end()
        return out + list(map(find, self.split(text[at:])))

    def ids(self, text: str) -> list[int]:
        return [int(x) for piece in self.pieces(text) for x in piece[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens with one space between them, as the vocabulary has no decoder of its own."""
        return " ".join([self.tokens[x] for x in ids])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(documents: DataFrame, vocabulary: str, *, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    ``vocabulary`` is the path of the vocabulary file on every machine. Result: doc_id, n_tokens,
    ids_sha256, decoded_sha256, and the ids themselves if ``with_ids``. A null text is empty: no
    ids, the hash of the empty text. Rows are independent: repeated rows and null ids are kept as
    they come, other columns are not read.
    """
    fields = FIELDS + ((("ids", "array<int>"),) if with_ids else ())

    def of_slice(doc_ids, texts):
        model = encoder(vocabulary)
        counts, hashes, decoded, ids = [], [], [], []
        for text in texts:
            pieces = model.pieces(text)
            n, numbers, words = zip(*pieces, strict=True) if pieces else ((), (), ())
            numbers = " ".join(numbers)
            counts.append(sum(n))
            hashes.append(sha(numbers))
            decoded.append(sha(" ".join(words)))
            if with_ids:
                ids.append([int(x) for x in numbers.split()])
        return [doc_ids, counts, hashes, decoded, *([ids] if with_ids else [])]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return map_slices(rows, of_slice, fields)

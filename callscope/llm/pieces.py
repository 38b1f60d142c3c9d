"""Sentence-piece encoding by a table of each prefix's last token.

The library joins, again and again, the two neighbouring parts whose joint piece has the best score,
leftmost first among equals. The result of that is fixed for every prefix of a text by its *last*
token alone: the tokens before it are the result for the shorter prefix. So one pass over a unit
of text fills a table: an automaton reports all pieces that end at a place, and the one that
belongs there is the one that starts where the table has a token it can stand beside. Two tokens
can stand beside each other if joining their letters gives just these two, which is tested by
walking up the parts along their common border in the order in which the merges happen. Ids are
then recovered backwards from the end of the table.

A unit is a run of word separators with the letters after it, and ends before a sign that follows a
letter in no piece: no piece goes on past the end of a unit. Both follow from the vocabulary when
it is read. Units repeat, so each worker keeps two generations of encoded units of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.bpe import Cache, sha
from callscope.llm.common import map_slices, whole

#: Fixed values of the format: the mark of a word's start, what an unknown id decodes to.
MARK = "▁"
UNKNOWN = " ⁇ "
#: Answers about neighbouring tokens that a worker keeps.
KNOWN_PAIRS = 1_000_000
#: Units in the younger generation of a worker's encoded units.
CACHE_UNITS = 250_000
#: A letter, and the signs that may end a unit.
LETTER = r"[^\W\d_]"
SIGNS = "\n!\"#$%&'()*+,-./:;<=>?@[]^`{|}~"

FIELDS = (("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))


class Pieces:
    """A merge vocabulary with byte fallback and no normalisation but the mark, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[str | None] = []
        self.byte: dict[int, int] = {}  # id -> value
        self.number: dict[str, int] = {}
        self.cost: dict[str, float] = {}  # of a merge that gives the piece; least goes first
        for k in range(file.get_piece_size()):
            text = file.id_to_piece(k)
            if file.is_byte(k):
                self.byte[k] = int(text[3:5], 16)
                self.texts.append(None)
            elif file.is_control(k) or file.is_unknown(k) or file.is_unused(k):
                self.texts.append(UNKNOWN if file.is_unknown(k) else "")
            else:
                if MARK in text.lstrip(MARK):
                    raise ValueError("a piece goes on past the start of a word")
                self.texts.append(text)
                self.number[text] = k
                self.cost[text] = -file.get_score(k)
        if file.unk_id() >= 0:
            self.texts[file.unk_id()] = UNKNOWN
        self.of_byte = [k for k, _ in sorted(self.byte.items(), key=lambda x: x[1])]
        if len(self.of_byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(letter not in self.number for text in self.number for letter in text):
            raise ValueError("a piece has a letter that is no piece")
        # The parts along the left and the right border of each token, smallest first, each with the
        # cost of the merge that makes it; pieces that merging never leaves whole are no tokens.
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for text in self.number:
            halves = self.halves(text)
            if halves is None:
                continue
            self.left[text], self.right[text] = halves
            self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        inside = {b for x in self.left for a, b in zip(x, x[1:], strict=False) if re.match(LETTER, a)}
        signs = "".join(x for x in SIGNS if x not in inside)
        ends = f"{MARK}*[^{MARK}]*?{LETTER}(?=[{re.escape(signs)}])|" if signs else ""
        self.units = re.compile(f"{ends}{MARK}*[^{MARK}]+|{MARK}+").findall
        self.cache = Cache(self.describe, CACHE_UNITS)

    def halves(self, text: str) -> tuple[list, list] | None:
        """Border parts of a piece by merging its own letters, or None if they do not become one."""
        parts, left, right = list(text), [(text[0], -1.0)], [(text[-1], -1.0)]
        while len(parts) > 1:
            costs = [self.cost.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(costs)
            if least == float("inf"):
                return None
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left.append((parts[0], least))
            if i == len(parts) - 1:
                right.append((parts[-1], least))
        return left, right

    def fits(self, first: str, second: str) -> bool:
        """Whether the letters of two tokens in a row become just these two tokens.

        Follows the parts at the border in time. They are joined if their merge comes before the
        next one inside the first token, and not after the next one inside the second: among
        equal costs the leftmost merge is done, so the first token's own come before and the
        second's come after.
        """
        end = float("inf")
        a, b = self.right[first], self.left[second]
        i = j = 0
        while True:
            next_a = a[i + 1][1] if i + 1 < len(a) else end
            next_b = b[j + 1][1] if j + 1 < len(b) else end
            joint = self.cost.get(a[i][0] + b[j][0], end)
            if joint < end and joint < next_a and joint <= next_b:
                return False
            if next_a == end and next_b == end:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a unit; a letter outside the vocabulary is one by itself."""
        n = len(unit)
        last: list[str | None] = [None] * (n + 1)  # of the prefix of each length
        pairs, whole_tokens, filled = self.pairs, self.right, 0
        for end, token in self.automaton.iter(unit):
            end += 1
            while filled < end - 1:  # nothing ends there: a letter that no piece has
                filled += 1
                if last[filled] is None:
                    last[filled] = unit[filled - 1]
            if last[end] is not None:
                continue
            start = end - len(token)
            if start:
                before = last[start]
                if before in whole_tokens:
                    key = before, token
                    fit = pairs.get(key)
                    if fit is None:
                        if len(pairs) >= KNOWN_PAIRS:
                            pairs.clear()
                        fit = pairs[key] = self.fits(before, token)
                    if not fit:
                        continue
            last[end] = token
            filled = end
        while filled < n:
            filled += 1
            if last[filled] is None:
                last[filled] = unit[filled - 1]
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def unit_ids(self, unit: str) -> list[int]:
        ids = []
        for token in self.tokens(unit):
            number = self.number.get(token)
            if number is None:
                ids += [self.of_byte[b] for b in token.encode()]
            else:
                ids.append(number)
        return ids

    def describe(self, unit: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and what they decode to inside a text."""
        ids = self.unit_ids(unit)
        return len(ids), ",".join(map(str, ids)), self.joined(ids)

    def split(self, text: str) -> list[str]:
        return self.units(MARK + text.replace(" ", MARK)) if text else []

    def ids(self, text: str) -> list[int]:
        return [k for unit in self.split(text) for k in self.unit_ids(unit)]

    def joined(self, ids: Sequence[int]) -> str:
        """Letters of ids in a row, marks as spaces. Bytes that are no letter become U+FFFD each."""
        out, held = [], bytearray()

        def flush():
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    size = 1
                at += size
            held.clear()

        for k in ids:
            if k in self.byte:
                held.append(self.byte[k])
            else:
                if held:
                    flush()
                out.append(self.texts[k])
        if held:
            flush()
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a whole row of ids: the mark put before the first word is taken off."""
        first = next((k for k in ids if k in self.byte or self.texts[k]), None)
        text = self.joined(ids)
        marked = first is not None and first not in self.byte and self.texts[first].startswith(MARK)
        return text[1:] if marked else text


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(documents: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    ``model`` is the path of the model file on every machine. Result: doc_id, n_tokens, ids_sha256
    (of the ids joined by commas), decoded_sha256, and the ids themselves if ``with_ids``. A null
    text is empty: no ids, hashes of the empty text. Rows are independent: repeated rows and null
    ids are kept as they come, other columns are not read.
    """
    fields = FIELDS + ((("ids", "array<int>"),) if with_ids else ())

    def of_slice(doc_ids, texts):
        vocabulary = pieces(model)
        find = vocabulary.cache.__getitem__
        counts, hashes, decoded, ids = [], [], [], []
        for text in texts:
            found = list(map(find, vocabulary.split(text)))
            n, numbers, parts = zip(*found, strict=True) if found else ((), (), ())
            numbers, own = ",".join(numbers), hashlib.sha256("".join(parts)[1:].encode())
            counts.append(sum(n))
            hashes.append(sha(numbers))
            decoded.append(own.hexdigest())
            if with_ids:
                ids.append([int(x) for x in numbers.split(",")] if numbers else [])
        return [doc_ids, counts, hashes, decoded, *([ids] if with_ids else [])]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return map_slices(rows, of_slice, fields)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids. A null row has a null text; ids outside the vocabulary are an error."""

    def of_slice(doc_ids, lists):
        vocabulary = pieces(model)
        return [doc_ids, [None if own is None else vocabulary.decode(own) for own in lists]]

    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_slices(chosen, of_slice, (("doc_id", "long"), ("text", "string")))

"""Quality rules that look at lines first.

Each line with a word is tested against three rules. A line fails if it is short and does not end
as a sentence does or is strewn with symbols (punctuation), if separators cut it into many short items (navigation), or if
it is short and holds a fixed phrase of page furniture (boilerplate). Failing lines are removed;
a document that loses more than ``MAX_LOSS`` of the characters in its words is rejected.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import map_rows, whole

SHORT_LINE = 5
FURNITURE_WORDS = 40
MAX_LOSS = 0.5
#: Most symbols per letter of the words in a line.
MAX_SYMBOLS = 0.15

#: Phrases of page furniture, fixed values.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "leave a comment",
    "log in",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "share this",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "we use cookies",
)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_ENDS = tuple(".!?:;,…\"'”»)]}。！？")
_SEPARATORS = re.compile("[|•»›·>]")

FIELDS = (
    ("doc_id", "long"),
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("n_lines", "long"),
    ("n_removed_lines", "long"),
    ("removed_chars", "long"),
)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice, the first included."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    one = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)

    def joined(left, right):
        return np.unique(left * len(one) + right, return_inverse=True)[1]

    grams = one
    for step in range(1, size):
        grams = joined(grams[: len(one) - step], one[step:])
        if step < size - 1 and grams.max() + 1 == len(grams):
            return 0  # all different already
    repeated = np.bincount(grams)[grams] > 1
    cover = np.zeros(len(one) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def line_rule(line: str, words: int) -> str | None:
    """The name of the rule that the line fails, or None. ``words`` is at least 1."""
    if sum(map(line.count, "#*$%&~^@!")) > MAX_SYMBOLS * len(line):
        return "punctuation"
    if words >= SHORT_LINE and not _SEPARATORS.search(line):
        furniture = words <= FURNITURE_WORDS and _FURNITURE.search(line)
        return "boilerplate" if furniture else None
    if len(items := [x for x in _SEPARATORS.split(line) if x.strip()]) >= 3 and words <= 3 * len(items):
        return "navigation"
    if words < SHORT_LINE and not line.rstrip().endswith(_ENDS):
        return "punctuation"
    if words <= FURNITURE_WORDS and _FURNITURE.search(line):
        return "boilerplate"
    return None


def judge(text: str) -> tuple:
    """The result columns after doc_id, for one text."""
    data = text.encode()
    words = data.split()  # bytes are split at space and 09-0D only
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    seen: set[str] = set()
    duplicate = lines = removed = lost = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        lines += 1
        if line in seen:
            duplicate += 1
        seen.add(line)
        if line_rule(line, len(own)):
            removed += 1
            lost += len(b"".join(own).decode())
    kept = not failed and lost <= MAX_LOSS * chars
    return len(words), chars, symbols, duplicate, repeat, failed, kept, lines, removed, lost


def clean_text(text: str | None) -> str:
    """The text without the lines that fail a rule; lines without a word stay."""
    lines = (text or "").split("\n")
    words = [len(line.encode().split()) for line in lines]
    return "\n".join([x for x, n in zip(lines, words, strict=True) if not n or not line_rule(x, n)])


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts, base verdict and verdict of the line rules for every document.

    A null text has no words and fails the base rule. Rows are independent: null ids and repeated
    rows are kept as they come, other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return map_rows(rows, lambda doc_id, text: (doc_id, *judge(text)), FIELDS)

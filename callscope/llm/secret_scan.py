"""Secret scans: fixed patterns, and novelty measured with a primed compressor.

Three base patterns are always reported. Beyond them a candidate is a long run of key letters with
a sensitive word near it, before or after and over line ends; runs that follow each other with
nothing but white space and punctuation between them share the first one's surroundings, so that
a name or the BEGIN line of a private key holds for the whole block below it. Its novelty is the number of bytes that
zstandard needs more for the surrounding text with the candidate than without it, the compressor
primed with names from code; near as many bytes as letters means that neither the surroundings
nor the dictionary hold anything like it. Ordinary identifiers and paths compress well and stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import map_rows, prepare, whole

KINDS = ("assign", "access", "hex", "novel")
CONTEXT = 96
#: Least bytes per letter that count as incompressible. Random runs need 0.8 to 1.2, names 0.4 to 0.75.
NOVELTY = 0.78
#: Bytes that zstandard spends on any short addition, whatever it is.
OVERHEAD = 2

#: Plain words after the surroundings, so that the compressor codes letters and does not just copy a short text.
FILLER = "\nthe value of the name is then set by the code that follows here, and the rest of it goes on as before"

#: Patterns of the base spans, fixed values.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
SENSITIVE = re.compile(
    r"(?i:key|secret|token|passw|pwd|credential|auth|bearer|private|signature|cookie|session)"
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A name and its sign in front of a value of a candidate's length.
NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=+(?=[^=][A-Za-z0-9+/_=-]{15})")
#: What may stand between the lines of one block: white space, quotes and signs, escaped line ends.
BETWEEN = re.compile(r"(?:\\[nrt]|[^\w:])*")
PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
#: Lines of a key block without its END line, and the runs of key letters in a block.
OPEN_BODY = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,15}+={1,2})?+")
RUN = re.compile(r"\\[nrt]|([A-Za-z0-9+/=]+)")

FIELDS = (
    ("doc_id", "long"),
    ("n_assign", "long"),
    ("n_access", "long"),
    ("n_hex", "long"),
    ("base_sha256", "string"),
    ("spans", "string"),
    ("n_novel", "long"),
)


#: Words that names in code are made of, fixed values; names and samples follow from them by a rule.
KEYWORDS = """
and as assert async await boolean break byte case catch char class const continue def default delete do double
else enum except export extends false finally float for from func function global if implements import in int
interface is lambda let long match module namespace new nil none not null or override package pass private
protected public raise require return self short signed sizeof static string struct super switch template this
throw true try type typeof undefined union unsigned using var virtual void while with yield
""".split()
VERBS = """
add append apply build call check clear close compare compile copy count create decode delete encode execute
filter find flush format get handle insert iterate join list load lookup make merge move open parse print push
read remove replace reset resolve run save search send set sort split start stop update validate write
""".split()
NOUNS = """
access account address archive argument array attribute base binary buffer cache callback channel client code
collection column command config connection content context counter credential data database date decimal device
directory document element email encoding endpoint engine entry environment error event exception factory field
file filename flag folder footer frame graph group handler hash header host identifier image index input instance
integer item iterator key label language length level library line link list locale lock log manager map memory
message method mode model module name network node number object offset option order output owner page parameter
password path pattern payload permission pointer port prefix process profile project property protocol provider
proxy query queue random range record reference region registry request resource response result role route row
schema scope script secret section security sequence server service session setting signature size socket source
stack state status storage stream string suffix symbol system table target task template text thread time
timestamp title token tree type url user value vector version view widget window worker
""".split()


def primer() -> zstandard.ZstdCompressionDict:
    """A dictionary of names from code, with the letter statistics of such names.

    Its entropy tables make ordinary letters cheap and digits or mixed case dear, also where a text
    is too short for the compressor to learn its own. It is the same for every version of the interpreter.
    """
    parts = sorted({*KEYWORDS, *VERBS, *NOUNS})
    near = zip(parts, parts[7:] + parts[:7], parts[31:] + parts[:31], strict=True)
    samples = [f'self.{a}_{b} = get{c.title()}{a.title()}(config["{b}"])\nthe {a} of {c}: {b}.{a}\n'.encode() for a, b, c in near]
    return zstandard.train_dictionary(16384, samples, level=19)


class Novelty:
    """Marginal compressed bytes of a candidate in its surroundings."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(
            level=19, dict_data=primer(), write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def bytes_more(self, before: str, candidate: str, after: str) -> int:
        size = lambda text: len(self.compressor.compress((text + FILLER).encode()))
        return size(before + candidate + after) - size(before + after)

    def ratio(self, before: str, candidate: str, after: str) -> float:
        return (self.bytes_more(before, candidate, after) - OVERHEAD) / len(candidate)


_NOVELTY: list[Novelty] = []


def novelty() -> Novelty:
    if not _NOVELTY:
        _NOVELTY.append(Novelty())
    return _NOVELTY[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def private_spans(text: str) -> list[tuple[int, int, int]]:
    """The lines of private key blocks; one line that is novel beside the BEGIN line decides for its block."""
    found = []
    for begin in PRIVATE.finditer(text):
        at = begin.end()
        stop = text.find("-----", at)
        if stop < 0 or not text.startswith("-----END", stop):
            stop = OPEN_BODY.match(text, at).end()
        runs = [m for m in RUN.finditer(text, at, stop) if m[1]]
        lines = [m for m in runs if len(m[1]) >= 16]
        if any(novelty().ratio(begin[0] + "\n", m[1], "") >= NOVELTY for m in lines):
            found += [(m.start(), 3, m.end()) for m in runs if len(m[1]) >= 16 or m is runs[-1]]
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = private_spans(text) if "PRIVATE KEY" in text else []
    inner = sorted(found)
    # Spans of one base kind do not overlap, so their starts and their ends are both in order.
    kinds = [([s for s, k, _ in base if k == kind], [e for _, k, e in base if k == kind]) for kind in range(3)]
    last, before, near = -1, "", False
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        if start and text[start - 1] == "\\" and text[start] in "nrt" and end - start > 16:
            start += 1  # the letter of an escaped line end
        if name := NAMED.match(text, start, end):
            start = name.end()
        word = text[start:end]
        if name or last < 0 or not BETWEEN.fullmatch(text, last, match.start()):
            before = text[max(0, start - CONTEXT) : start]
            near = bool(SENSITIVE.search(before))
        last = end
        after = text[end : end + CONTEXT]
        if not near and not SENSITIVE.search(after):
            continue
        at = [bisect_right(ends, start) for _, ends in kinds]  # the first of each kind that ends behind the start
        own = bisect_left(inner, (end,)) - 1  # the last line of a private key that starts before the end
        if (own >= 0 and inner[own][2] > start) or any(
            k < len(starts) and starts[k] < end for k, (starts, _) in zip(at, kinds, strict=True)
        ):
            continue
        if CANDIDATE.match(text, BETWEEN.match(text, end).end()):
            after = CANDIDATE.sub("", after)  # lines of the same block are no surroundings
        if novelty().ratio(before, word, after) >= NOVELTY:
            found.append((start, 3, end))
    return found


def find(text: str) -> tuple[list, list]:
    """Base spans, and all spans, each in order of start, then kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def scan(documents: DataFrame) -> DataFrame:
    """Spans of every document, as code points with the end excluded.

    A null text is empty and has no spans. Spans of different kinds may overlap. Rows are
    independent: null ids and repeated rows are kept as they come, other columns are not read.
    """

    def of_row(doc_id, text):
        base, spans = find(text)
        counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
        return doc_id, *counts[:3], hashlib.sha256(said(base).encode()).hexdigest(), said(spans), counts[3]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return map_rows(rows, of_row, FIELDS)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of spans replaced by a mark."""
    if not text:
        return text
    spans = find(text)[1]
    if not spans:
        return text
    out, at = [], 0
    end = -1
    for start, _, stop in spans:
        if start >= max(end, at) and start > end - 1:
            out += [text[at:start], mark]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """The table with secrets replaced in ``text`` and ``n_chars`` counted anew; all columns stay."""
    prepare(documents.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(text) for text in texts], dtype=object)

    out = documents.withColumn("text", clean(F.col("text")))
    if "n_chars" in documents.columns:
        changed = F.col("text").isNotNull()
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out

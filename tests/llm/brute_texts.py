"""Plain versions of the text operators for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def removed_bytes(texts, span=400):
    """(bytes, removed, runs, hash of the rest) by counting every string of ``span`` bytes."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if counts[b[i : i + span]] > 1:
                mark[i : i + span] = b"\1" * span
        runs = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, sha(bytes(x for x, y in zip(b, mark) if not y))))
    return out


def components(ids, prints, most=2):
    """Smallest id reachable over pairs of fingerprints with at most ``most`` differing bits."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= most):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return [least.get(find(i)) for i in range(len(ids))]


def contamination(text, items, window=13):
    """(words, hit words, items) by comparing every window of the text with every item window."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words, hit, names = pattern.findall(low(text)), set(), set()
    for name, item in items:
        own = pattern.findall(low(item))
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def article(source):
    """Text of the only <article> of a generated page, read with plain patterns."""
    import html

    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.DOTALL)[1]
    blocks = []
    for part in re.split(r"</?(?:p|h1|h2|li|ul|div|blockquote)\b[^>]*>", inner):
        text = re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", part)
        text = " ".join(html.unescape(text).split())
        blocks += [text] if text else []
    return "\n".join(blocks)

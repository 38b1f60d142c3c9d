"""Sorted runs of suffix keys: front coding, and a merge that never compares a known prefix twice.

A run is sorted and holds each key once; a key is stored as the length of the prefix it shares
with the one before, whether it was seen more than once, and the rest. The loser tree carries
with every waiting key the prefix length it shares with the last key put out. Of two keys the one
sharing more comes first; only at equal lengths are letters compared, from that place on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def front_coded(keys: dict[bytes, int]) -> bytes:
    """A run from keys of one length (at most 255) and their numbers of occurrences."""
    out, last = bytearray(), b""
    for key in sorted(keys):
        same = shared(last, key, 0)
        out += bytes((same, min(keys[key], 255)))
        out += key[same:]
        last = key
    return bytes(out)


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two keys that agree up to ``start``."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    low = start
    while a[low] == b[low]:
        low += 1
    return low


def decoded(run: bytes, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(key, prefix shared with the key before, occurrences) of a run."""
    at, last = 0, b""
    while at < len(run):
        same, times = run[at], run[at + 1]
        last = last[:same] + run[at + 2 : at + 2 + length - same]
        at += 2 + length - same
        yield last, same, times


def merged(runs: Iterable[bytes], length: int) -> Iterator[tuple[bytes, int]]:
    """Different keys of all runs in order, each with its occurrences."""
    sources = [decoded(run, length) for run in runs]
    k = 1
    while k < len(sources):
        k *= 2
    ended = (None, -1, 0)
    heads = [next(source, ended) for source in sources] + [ended] * (k - len(sources))
    lengths = [0] * k  # prefix shared with the last key put out
    losers = [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's length is brought up to date."""
        x, y = heads[a][0], heads[b][0]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lengths[a] != lengths[b]:
            return (a, b) if lengths[a] > lengths[b] else (b, a)
        same = shared(x, y, lengths[a])
        if same == length or x[same] < y[same]:
            lengths[b] = same
            return a, b
        lengths[a] = same
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = first(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    last, times = None, 0
    while (head := heads[winner])[0] is not None:
        if last is not None and lengths[winner] == length:
            times += head[2]
        else:
            if last is not None:
                yield last, times
            last, times = head[0], head[2]
        heads[winner] = follower = next(sources[winner], ended)
        lengths[winner] = max(follower[1], 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = first(winner, losers[node])
            node //= 2
    if last is not None:
        yield last, times

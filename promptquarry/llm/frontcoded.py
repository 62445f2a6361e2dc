"""Sorted runs of byte strings: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def lcp(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which so much is known."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    lo, step = known, 16
    while x[lo : lo + step] == y[lo : lo + step]:
        lo, step = lo + step, 2 * step
    while step > 1:
        step //= 2
        if x[lo : lo + step] == y[lo : lo + step]:
            lo += step
    return lo


def encode(strings: list[bytes], known: list[int] | None = None) -> bytes:
    """Front-codes a sorted run: per string the prefix it shares with the one before it, and what follows."""
    shared = known or [0] + [lcp(a, b) for a, b in zip(strings, strings[1:])]
    shared[:1] = [0] if strings else []
    head = np.array([[p, len(s) - p] for p, s in zip(shared, strings)], np.uint32).reshape(-1, 2)
    body = b"".join(s[p:] for p, s in zip(shared, strings))
    return zstandard.ZstdCompressor(level=3).compress(len(strings).to_bytes(8, "little") + head.tobytes() + body)


def decode(blob: bytes) -> tuple[list[bytes], list[int]]:
    """The run's strings and each one's common prefix with the one before it."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.uint32, 2 * n, 8).reshape(-1, 2).tolist()
    at, last, out = 8 + 8 * n, b"", []
    for shared, rest in head:
        last = last[:shared] + raw[at : at + rest]
        at += rest
        out.append(last)
    return out, [h[0] for h in head]


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs. Yields run, index in it, and the common prefix with the string yielded before.

    Every run's front has a known common prefix with the last winner. Of two fronts the one that shares more of it is
    smaller; only if they share equally much are bytes compared, from there on. A node of the tree keeps the loser of
    its match with its prefix to the winner, which is the last output once the winner leaves."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    place, front, known = [0] * k, [s[0] if s else None for s in strings], [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one with the winner."""
        if front[b] is None:
            return a, b
        if front[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        p = lcp(front[a], front[b], known[a])
        x, y = front[a], front[b]
        if p == len(x) or (p < len(y) and x[p] < y[p]):
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while front[winner] is not None:
        i = place[winner]
        yield winner, i, known[winner]
        place[winner] = i = i + 1
        if i < len(strings[winner]):
            front[winner], known[winner] = strings[winner][i], shared[winner][i]
        else:
            front[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = match(winner, losers[node])
            node //= 2

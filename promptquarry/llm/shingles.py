"""Word shingles as 64-bit hashes, computed for many texts at once with numpy.

A word's hash is a polynomial of its bytes, a shingle's one of its words' mixed hashes. Everything is a function of
the words alone, so equal shingles have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import LOWER_AZ, WS_BYTES, lean_memory

CHUNK_BYTES = 1 << 20
#: For sets of shingles, whose arrays take about 50 bytes for each byte of text.
SET_CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WS_BYTES)] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about limit bytes, with the first one's index; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and each text's number of words. A-Z count as a-z."""
    raw = np.frombuffer(b"\n".join(texts).translate(LOWER_AZ) + b"\n", np.uint8)
    is_word = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def word_shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of place, and each text's number of them. A text with fewer words than the width has
    its whole sequence as one shingle; one without words has none."""
    hashes, n = words(texts)
    if not len(hashes):
        return hashes, n
    step, total = 1, np.zeros(len(hashes), np.uint64)
    for j in range(min(width, len(hashes))):
        total[: len(hashes) - j] += hashes[j:] * np.uint64(step)
        step = step * _STEP & (1 << 64) - 1
    at = np.concatenate([[0], np.cumsum(n)])
    left = np.repeat(at[1:], n) - np.arange(len(hashes))  # words from here to the text's end
    first = np.zeros(len(hashes), bool)
    first[at[:-1][n > 0]] = True
    keep = left >= width
    short = np.flatnonzero(first & (left < width))
    for i in short:
        step, value = 1, int(left[i])
        for h in hashes[i : i + left[i]].tolist():
            value += h * step
            step = step * _STEP & (1 << 64) - 1
        total[i] = np.uint64(value & (1 << 64) - 1)
    keep[short] = True
    counts = np.add.reduceat(keep, at[:-1][n > 0]).astype(np.int64) if n.any() else np.zeros(0, np.int64)
    out = np.zeros(len(texts), np.int64)
    out[n > 0] = counts
    return mix64(total[keep]), out


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for _, part in chunks(texts, SET_CHUNK_BYTES):
        values, n = word_shingles(part, width)
        at = 0
        for k in n:
            yield np.unique(values[at : at + k])
            at += k


def as_bytes(texts) -> list[bytes]:
    lean_memory()
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]

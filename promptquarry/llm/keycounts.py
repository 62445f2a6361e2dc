"""Counts of 64-bit keys over the whole corpus, asked for and answered block by block.

A block sends its distinct keys, sorted and delta-coded, in slices to the buckets of the key space, with one or more
counts per key; a bucket sums the counts of each key over all blocks and answers each block with the totals in the
order of its keys. A key travels once per block however often it occurs, so a frequent key costs its bucket at
most one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

REQUEST = "bucket long, block long, keys binary, counts binary"
ANSWER = "block long, bucket long, totals binary, distinct_even long"


def pack(values: np.ndarray) -> bytes:
    """Bytes by significance, so that zstd sees the small ones' zeros in rows."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the sorted keys' slices begin; the last entry is their number."""
    width = ((1 << 64) + n_buckets - 1) // n_buckets
    edges = np.array([i * width for i in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]])


def requests(block: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """keys sorted and distinct; counts: one row per kind of count, uint32."""
    bounds, rows = bucket_bounds(keys, n_buckets), []
    for b in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[b], bounds[b + 1])
        rows.append((int(b), block, pack(np.diff(keys[own], prepend=np.uint64(0))), pack(counts[:, own].reshape(-1))))
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])


def _answer(kinds: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in frame["keys"]]
        counts = np.concatenate([unpack(c, np.uint32).reshape(kinds, -1) for c in frame["counts"]], axis=1)
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros((kinds, len(values)), np.uint64)
        for i in range(kinds):
            totals[i] = np.bincount(inverse, counts[i], len(values)).astype(np.uint64)
        rows, at = [], 0
        for block, own in zip(frame["block"], keys):
            got = totals[:, inverse[at : at + len(own)]]
            rows.append((block, frame["bucket"].iloc[0], pack(np.ascontiguousarray(got).reshape(-1)), 0))
            at += len(own)
        out = pd.DataFrame(rows, columns=["block", "bucket", "totals", "distinct_even"])
        out.loc[0, "distinct_even"] = int(((totals.sum(0) > 0) & (values & np.uint64(1) == 0)).sum())
        return out

    return answer


def answered(asked: DataFrame, kinds: int = 1) -> DataFrame:
    """block, bucket, totals, distinct_even (even keys with a count, noted once per bucket) for rows of REQUEST."""
    return asked.groupBy("bucket").applyInPandas(_answer(kinds), ANSWER)


def gathered(parts: Iterator[tuple[int, bytes]], kinds: int) -> np.ndarray:
    """A block's answers in the order of its keys: one row per kind of count."""
    return np.concatenate([unpack(t, np.uint64).reshape(kinds, -1) for _, t in sorted(parts)] or [np.zeros((kinds, 0), np.uint64)], axis=1)

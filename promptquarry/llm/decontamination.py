"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks and
verified by exact weighted-shingle similarity.

The benchmark is the query set; it is held in blocks of about BLOCK_WORDS words and BLOCK_ITEMS items, each compared with all documents.
A window has as many words as the item it is compared with (a shorter document is one window). Only windows that
share a shingle with an item of that length are fingerprinted: any other has similarity 0. Fingerprints have 192
bits in 16 blocks of 12; by pigeonhole two of them within RADIUS = 16 * (BLOCK_ERRORS + 1) - 1 bits agree in some block up
to BLOCK_ERRORS bits. Each block has a table from every value within that error to the items (79 values an item), so a
lookup per block finds all of them; of pairs that have nothing in common about a third meets. Windows of similarity 0.8 differ in 28 bits on
average (standard deviation 5), inside the radius of 47. What is found is verified by the weighted Jaccard similarity of
the shingle multisets.

Defined cases: words are compared with A-Z lower-cased; an item of fewer words than a shingle is one shingle, its whole
sequence, found only where a document has that very sequence; null or empty items and documents match nothing;
documents of any length are scanned whole; rows that repeat an item_id or doc_id are rows of their own before the
best window per doc_id and item_id is taken (ties: the first window); empty tables give an empty result; other
columns are ignored by leaks() and kept by the pipeline's stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches, words_count
from .keyfilter import without
from .shingles import as_bytes, chunks, mix64, word_shingles, words

WIDTH = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 16, 12, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
BLOCK_WORDS, BLOCK_ITEMS = 2_000_000, 20_000
FILTER_BITS = 1 << 20
STARTS = 4096
CODES = 1 << 20  # of pairs of windows and items that are held at once
_POPCOUNT = np.array([i.bit_count() for i in range(1 << BLOCK_BITS)], np.uint8)
#: What values of a block within BLOCK_ERRORS bits differ by.
_NEAR = np.flatnonzero(_POPCOUNT <= BLOCK_ERRORS).astype(np.uint16)
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
SCHEMA = "doc_id long, item_id long, start_word long, similarity double"


def votes(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' bits as -1 and 1: row i has the sum of the first i."""
    parts = np.stack([mix64(shingles ^ np.uint64(s)) for s in _SEEDS], 1)
    bits = np.unpackbits(np.ascontiguousarray(parts).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, bits.shape[1]), np.int32), np.cumsum(bits, 0, dtype=np.int32)])


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each window of so many shingles, as the values of its BLOCKS blocks. Windows are taken in runs, so long texts
    need no more room."""
    out = np.empty((len(starts), BLOCKS), np.uint16)
    weight = (1 << np.arange(BLOCK_BITS, dtype=np.uint16)).astype(np.uint16)
    for i in range(0, len(starts), STARTS):
        part = starts[i : i + STARTS]
        cuts = np.flatnonzero(np.diff(part) > width) + 1
        for run in np.split(np.arange(len(part)), cuts):
            lo, hi = part[run[0]], min(part[run[-1]] + width, len(shingles))
            sums = votes(shingles[lo:hi])
            at = part[run] - lo
            bits = sums[np.minimum(at + width, len(sums) - 1)] - sums[at] >= 0
            out[i + run] = (bits.reshape(len(run), BLOCKS, BLOCK_BITS) * weight).sum(2, dtype=np.uint16)
    return out


def weighted_similarity(window: np.ndarray, values: np.ndarray, counts: np.ndarray) -> float:
    """Sum of least over sum of greatest weights; a shingle's weight is its count."""
    own, n = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    least = int(np.minimum(n, counts[at])[values[at] == own].sum())
    most = len(window) + int(counts.sum()) - least
    return least / most if most else 0.0


class Group:
    """Items of one length, with the index of their fingerprints."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]]):
        self.width, self.ids = width, [i for i, _ in items]
        self.sets = [np.unique(s, return_counts=True) for _, s in items]
        self.prints = np.concatenate([fingerprints(s, np.zeros(1, np.int64), width) for _, s in items])
        item = np.repeat(np.arange(len(items), dtype=np.int32), len(_NEAR))
        self.tables = []
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ _NEAR).reshape(-1)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], item[order]))

    def met(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and items that some block's table brings together, in runs of windows with about CODES entries."""
        bounds = [(np.searchsorted(values, prints[:, b], "left"), np.searchsorted(values, prints[:, b], "right")) for b, (values, _) in enumerate(self.tables)]
        so_far = np.cumsum(sum(hi - lo for lo, hi in bounds))
        for run in np.split(np.arange(len(prints)), np.flatnonzero(np.diff(so_far // CODES)) + 1):
            codes = []
            for (lo, hi), (_, item) in zip(bounds, self.tables):
                n = hi[run] - lo[run]
                at = np.repeat(lo[run] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                codes.append(np.repeat(run, n) * len(self.ids) + item[at])
            yield np.divmod(np.unique(np.concatenate(codes)), len(self.ids))

    def within_radius(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        for w, i in self.met(prints):
            ok = _POPCOUNT[prints[w] ^ self.prints[i]].sum(1) <= RADIUS
            yield from zip(w[ok], i[ok])


class Index:
    """A block of the benchmark: by number of shingles per window, and by shingle."""

    def __init__(self, items: list[tuple[int, bytes]]):
        grouped: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            n_words = int(words([text])[1][0])
            if n_words:
                values, n = word_shingles([text], WIDTH)
                grouped.setdefault((min(n_words, WIDTH), int(n[0])), []).append((item_id, values))
        self.groups = [(width, Group(n, own)) for (width, n), own in sorted(grouped.items())]
        self.by_width = {}
        for width in {w for w, _ in self.groups}:
            pairs = [(g, v) for g, (w, group) in enumerate(self.groups) if w == width for v, _ in group.sets]
            values = np.concatenate([v for _, v in pairs])
            owner = np.concatenate([np.full(len(v), g) for g, v in pairs])
            order = np.lexsort((owner, values))
            values, owner = values[order], owner[order]
            seen = np.zeros(FILTER_BITS, bool)
            seen[(values & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
            self.by_width[width] = (values, owner, seen)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """Index of the text, item, first word and similarity of verified windows."""
        for first, part in chunks(texts):
            for width, (values, owner, seen) in self.by_width.items():
                shingles, n = sequences(part, width)
                hits = np.flatnonzero(seen[(shingles & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(values, shingles[hits], "left"), np.searchsorted(values, shingles[hits], "right")
                hits, lo, hi = (x[hi > lo] for x in (hits, lo, hi))
                if not len(hits):
                    continue
                bounds = np.cumsum(n)
                doc = np.searchsorted(bounds, hits, "right")
                found = np.repeat(np.arange(len(hits)), hi - lo)
                owners = owner[np.repeat(lo, hi - lo) + np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                keys = np.unique(np.stack([doc[found], owners, hits[found]], 1), axis=0)
                for run in np.split(keys, np.flatnonzero((np.diff(keys[:, 0]) != 0) | (np.diff(keys[:, 1]) != 0)) + 1):
                    d, g = int(run[0, 0]), int(run[0, 1])
                    base = int(bounds[d] - n[d])
                    own = shingles[base : base + n[d]]
                    for start, item, similarity in self._windows(self.groups[g][1], own, run[:, 2] - base):
                        yield first + d, item, start, similarity

    def _windows(self, group: Group, own: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, float]]:
        covered = np.zeros(len(own) + 1, np.int64)
        np.add.at(covered, np.maximum(hits - group.width + 1, 0), 1)
        np.add.at(covered, hits + 1, -1)
        last = max(0, len(own) - group.width)
        starts = np.flatnonzero(np.cumsum(covered)[: last + 1] > 0)
        if len(starts):
            prints = fingerprints(own, starts, group.width)
            for w, i in group.within_radius(prints):
                s = int(starts[w])
                similarity = weighted_similarity(own[s : s + group.width], *group.sets[i])
                if similarity >= SIMILARITY:
                    yield s, group.ids[i], similarity


def sequences(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of so many words; widths below WIDTH are those of short items, which have one shingle."""
    if width == WIDTH:
        return word_shingles(texts, WIDTH)
    hashes, n = words(texts)
    at, parts, counts = 0, [], []
    for k in n:
        own = hashes[at : at + k]
        at += k
        total = np.full(max(0, len(own) - width + 1), np.uint64(width))
        step = 1
        for j in range(width if len(total) else 0):
            total += own[j : j + len(total)] * np.uint64(step)
            step = step * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        parts.append(mix64(total))
        counts.append(len(total))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(counts, np.int64)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, similarity: each contaminated document with each item it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()  # repeated rows find the same
    total = items.agg(F.sum(words_count()), F.count("*")).first()
    n_blocks = max(1, math.ceil((total[0] or 0) / BLOCK_WORDS), math.ceil(total[1] / BLOCK_ITEMS))
    out = None
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        found, held = _against(docs, [(r["item_id"], *as_bytes([r["text"]])) for r in own.collect()])
        if n_blocks > 1:  # one block at a time is held, here and on the executors
            found = stored(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("at")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", (-F.col("best.at")).alias("start_word"), F.col("best.similarity").alias("similarity"))


def _against(docs: DataFrame, items: list[tuple[int, bytes]]) -> tuple[DataFrame, Broadcast]:
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(items)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value)
        for frame in frames:
            ids = frame["doc_id"].array
            rows = list(index.matches(as_bytes(frame["text"])))
            if rows:
                yield pd.DataFrame(
                    {"doc_id": ids[[r[0] for r in rows]], "item_id": pd.array([r[1] for r in rows], dtype="Int64"), "start_word": [r[2] for r in rows], "similarity": [r[3] for r in rows]}
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scan, SCHEMA), held


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that hold no benchmark item, with their own columns."""
    found = leaks(docs, benchmark).filter("doc_id IS NOT NULL").select("doc_id").distinct()
    return without(docs, F.col("doc_id").cast("long"), found)

"""Maximal periodic runs of words by branching tandem repeats of a suffix tree (Stoye and Gusfield), and their removal.

A run is a stretch of consecutive words with smallest period q that has at least max(LEAST_WORDS, LEAST_POWER * q) words
and that no neighbouring word extends. Each run ends in one branching tandem repeat: the suffixes at its last square and
one period later meet in the tree's node of depth q and leave it by different children. So at every node the leaves of
all children but the largest are listed, and each leaf's partners at plus and minus the node's depth are looked up by
their rank; a leaf is listed at most log2(n) times. A repeat is rotated to the left as far as words agree (a binary search
over common prefixes), which merges all repeats of a run into it; roots that are powers of a shorter one are dropped.

The tree is that of a suffix array with common prefixes, built by prefix doubling for all documents of a batch at once:
words of different documents are different symbols, so nothing crosses a document. Words that occur fewer than LEAST_POWER
times in their stretch can't be in a run; texts are cut at them before the tree is built, again and again, which changes
no result and leaves most of a text out.

Defined cases: words are maximal runs of characters outside ASCII white space, compared exactly; a null text, an empty one
and one without words have no runs and keep nothing; a text of any length is one unit of work, in memory proportional
to its length; repeated rows and doc_ids are rows of their own; a null doc_id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, text_batches
from .shingles import as_bytes, chunks

LEAST_WORDS, LEAST_POWER = 6, 4
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _candidates(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that can lie in a run, with a separator of its own after each stretch, and their places."""
    at, group = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    while len(at):
        _, inverse, n = np.unique(group * (int(symbols.max()) + 1) + symbols[at], return_inverse=True, return_counts=True)
        often = n[inverse] >= LEAST_POWER
        kept, own = at[often], group[often]
        if not len(kept):
            return np.zeros(0, np.int64), kept
        new = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(own) != 0)])
        group = np.cumsum(new) - 1
        long = np.bincount(group)[group] >= LEAST_WORDS
        done = often.all() and long.all()
        at, group = kept[long], group[long]
        if done:
            break
    ends = np.concatenate([np.flatnonzero(np.diff(group)), [len(at) - 1]]) if len(at) else np.zeros(0, np.int64)
    top = int(symbols.max()) + 1 if len(symbols) else 0
    return np.insert(symbols[at], ends + 1, top + np.arange(len(ends))), np.insert(at, ends + 1, -1)


class SuffixTree:
    """Suffix array with ranks of all prefixes of 2^l symbols; the last symbol must be unique."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.n = symbols, len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels, step = [self._padded(rank)], 1
        while int(rank.max()) + 1 < self.n:
            after = np.zeros(self.n, np.int64)
            after[: max(self.n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (self.n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.levels.append(self._padded(rank))
            step *= 2
        self.rank = rank
        self.suffixes = np.empty(self.n, np.int64)
        self.suffixes[rank] = np.arange(self.n)
        self.common = np.full(self.n, -1, np.int64)  # of each suffix with the one before it
        if self.n > 1:
            self.common[1:] = self.common_prefix(self.suffixes[:-1], self.suffixes[1:])

    def _padded(self, rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            step = (ranks[a] == ranks[b]).astype(np.int64) << level
            a, b, total = np.minimum(a + step, self.n), np.minimum(b + step, self.n), total + step
        return total

    def _smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entries of common to the left and to the right that are smaller."""
        minima, width = [self.common], 1
        while 2 * width <= self.n:
            minima.append(np.minimum(minima[-1][: self.n - 2 * width + 1], minima[-1][width : self.n - width + 1]))
            width *= 2
        left, right = np.arange(self.n) - 1, np.arange(self.n) + 1
        for level in range(len(minima) - 1, -1, -1):
            size, low = 1 << level, minima[level]
            start = left - size + 1
            go = (start >= 0) & (low[np.clip(start, 0, len(low) - 1)] >= self.common)
            left = np.where(go, left - size, left)
            go = (right + size <= self.n) & (low[np.clip(right, 0, len(low) - 1)] >= self.common)
            right = np.where(go, right + size, right)
        return left, right

    def small_leaves(self) -> tuple[np.ndarray, ...]:
        """Depth, first and end rank of a node, and a leaf below any of its children but the largest."""
        inner = np.flatnonzero(self.common >= 1)
        if not len(inner):
            return (inner,) * 4
        left, right = self._smaller()
        inner = inner[np.lexsort((inner, self.common[inner], left[inner]))]
        depth, lo, hi = self.common[inner], left[inner], right[inner]
        first = np.concatenate([[True], (np.diff(lo) != 0) | (np.diff(depth) != 0)])
        node = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        # children begin at the node's first rank and at each of its entries
        owner = np.concatenate([np.arange(len(heads)), node])
        begin = np.concatenate([lo[heads], inner])
        order = np.lexsort((begin, owner))
        owner, begin = owner[order], begin[order]
        last = np.concatenate([np.diff(owner) != 0, [True]])
        end = np.where(last, hi[heads][owner], np.append(begin[1:], 0))
        size = end - begin
        largest = np.lexsort((-size, owner))[np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])]
        small = np.ones(len(owner), bool)
        small[largest] = False
        owner, begin, size = owner[small], begin[small], size[small]
        each = np.repeat(np.arange(len(owner)), size)
        leaf = self.suffixes[begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)]
        return depth[heads][owner[each]], lo[heads][owner[each]], hi[heads][owner[each]], leaf

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and root length of all branching tandem repeats."""
        depth, lo, hi, leaf = self.small_leaves()
        found = []
        for start in (leaf, leaf - depth):
            other = np.where(start == leaf, leaf + depth, start)  # the partner of the listed leaf
            inside = (start >= 0) & (other < self.n)
            rank = self.rank[np.clip(other, 0, self.n - 1)]
            ok = inside & (lo <= rank) & (rank < hi)
            s, d = start[ok], depth[ok]
            branches = self.symbols[s + d] != self.symbols[np.minimum(s + 2 * d, self.n - 1)]
            found.append(np.stack([s[branches], d[branches]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def runs(self) -> list[tuple[int, int, int]]:
        """Start, end and period of all runs."""
        start, period = self.branching_repeats()
        need = np.maximum(LEAST_WORDS, LEAST_POWER * period) - 2 * period
        reaches = lambda s, b, q: (s >= 0) & (self.common_prefix(np.maximum(s, 0), np.maximum(s, 0) + q) >= b - s + q)
        ok = start >= need
        start, period, need = start[ok], period[ok], need[ok]
        ok = reaches(start - need, start, period)
        start, period, need = start[ok], period[ok], need[ok]
        good, bad = start - need, np.full(len(start), -1)  # rotated to the left: the least start that still agrees
        while (good - bad > 1).any():
            middle = (good + bad) // 2
            agrees = reaches(middle, start, period) & (middle > bad)
            good, bad = np.where(agrees, middle, good), np.where(agrees, bad, np.where(good - bad > 1, middle, bad))
        end = start + 2 * period
        out: list[tuple[int, int, int]] = []
        here, at = [], -1
        for i in np.lexsort((period, end)).tolist():
            if end[i] != at:
                here, at = [], end[i]
            if all(start[i] < s for s in here):  # else a power of that run's root
                here.append(good[i])
                out.append((int(good[i]), int(end[i]), int(period[i])))
        return out


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs as start, length and period, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    joined = np.empty(int(sizes.sum()), object)
    joined[:] = [w for t in texts for w in t]
    codes, values = pd.factorize(joined)
    doc = np.repeat(np.arange(len(texts)), sizes)
    symbols, places = _candidates(doc * len(values) + codes)
    if not len(places):
        return out
    starts = np.cumsum(sizes) - sizes
    for start, end, period in SuffixTree(symbols).runs():
        first = int(places[start])
        out[doc[first]].append((first - int(starts[doc[first]]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by a blank."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids = frame["doc_id"].array
        for first, part in chunks(as_bytes(frame["text"])):
            words = [text.split() for text in part]  # bytes split at ASCII white space
            runs = find_runs(words)
            out = pd.DataFrame({"runs": [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]})
            out["collapsed"] = [collapse(w, own).decode("utf-8", "replace") for w, own in zip(words, runs)]
            out.insert(0, "doc_id", ids[first : first + len(part)])
            yield out


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period by start and period), collapsed (the kept words) for each row; text is the
    column text unless given."""
    text_batches(docs.sparkSession)
    text = F.col("text") if text is None else text
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return own.mapInPandas(_scan, SCHEMA)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of all documents with its end repeated from a word on, as op13's contract defines it."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    changed = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(copies), F.lit(1), n - a))
    return F.when((h % 10 == 0) & text.rlike(WORD_CLASS), F.array_join(changed, " ")).otherwise(text)


def digest_columns(found: DataFrame) -> DataFrame:
    """n_runs, the longest run, exponent_milli and digests of the runs and the kept words, from periodic_runs()."""
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", key))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("__best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.s").alias("start"),
        (-F.col("__best.l")).alias("length"),
        F.col("__best.p").alias("period"),
        F.floor(-1000 * F.col("__best.l") / F.col("__best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

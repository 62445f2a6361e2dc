"""Language-model scores by deleted interpolation.

A bigram model: P(w | v) = a(v) c(v w) / c(v) + b(v) c(w) / N + (1 - a(v) - b(v)) / (V + 1), where the mixture weights
depend on v by a bucket of its frequency (powers of two). The counts come from all training documents. The weights are
learned by expectation-maximisation on counts that are held out from them: one of the nine training folds is
left out of the estimates and its tokens are the evidence. Documents whose crc32(doc_id) mod 10 is 0 are no part
of any estimate.

The corpus is cut into blocks of tokens, kept as a table of word numbers. Each block asks for the counts of its distinct
words and word pairs (keycounts.py) and scores its documents with the answers. A word is known by 63 bits of its hash, a
pair by 63 bits of its words' hashes; equal hashes count as equal words without a comparison. What EM reads is a histogram of the
two estimates on a logarithmic grid per bucket, whose size doesn't depend on the corpus.

Defined cases: a null text is empty; every document has at least its end token; a text's first word follows an end; a
null doc_id is held in training with the id's text empty; rows that repeat a doc_id are rows of their own; without
training documents the model is uniform and base_score uses N = V = 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, text_batches
from .keycounts import REQUEST, answered, gathered, pack, requests, unpack
from .shingles import as_bytes, chunks, mix64, words

FOLDS, HELD_OUT, EM_FOLD = 10, 0, 1
BLOCK_TOKENS = 1 << 20
KEYS_PER_BUCKET = 1 << 20
BUCKETS = 24
GRID = 8  # steps per power of two
EM_ROUNDS = 60
#: Words have even keys, pairs odd ones.
ODD = np.uint64(1)
END = np.uint64(0x5851F42D4C957F2C)
BLOCK_SCHEMA = "block long, em boolean, n_tokens long, ids binary, missing binary, folds binary, lengths binary, words binary, tokens binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS


class _Block:
    def __init__(self):
        self.ids, self.folds, self.lengths, self.parts, self.size = [], [], [], [], 0

    def add(self, doc_id, fold: int, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.folds.append(fold)
        self.lengths.append(len(hashes) + 1)
        self.parts += [hashes, np.array([END], np.uint64)]
        self.size += len(hashes) + 1

    def row(self, block: int, em: bool) -> tuple:
        vocabulary, tokens = np.unique(np.concatenate(self.parts), return_inverse=True)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        missing = np.array([i is None for i in self.ids], np.uint8)
        lengths = np.array(self.lengths, np.uint32)
        return (block, em, self.size, ids.tobytes(), missing.tobytes(), np.array(self.folds, np.uint8).tobytes(), lengths.tobytes(), pack(np.diff(vocabulary, prepend=np.uint64(0))), pack(tokens.astype(np.uint32)))


def make_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the EM fold's documents and of the others."""
    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    base, made = TaskContext.get().partitionId() << 32, 0
    open_blocks = {True: _Block(), False: _Block()}
    for frame in frames:
        ids = frame["doc_id"].astype(object)
        for start, part in chunks(as_bytes(frame["text"])):
            hashes, n = words(part)
            hashes &= ~ODD
            at = 0
            for doc_id, k in zip(ids.iloc[start : start + len(part)], n):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                fold = fold_of(doc_id)
                em = fold == EM_FOLD
                open_blocks[em].add(doc_id, fold, hashes[at : at + k].copy())
                at += k
                if open_blocks[em].size >= BLOCK_TOKENS:
                    yield pd.DataFrame([open_blocks[em].row(base + made, em)], columns=columns)
                    open_blocks[em], made = _Block(), made + 1
    for em, block in open_blocks.items():
        if block.size:
            yield pd.DataFrame([block.row(base + made, em)], columns=columns)
            made += 1


class Tokens:
    """A block's tokens with its distinct keys: the words' and the pairs', sorted together."""

    def __init__(self, row):
        self.block = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.missing = np.frombuffer(row.missing, np.uint8).astype(bool)
        self.folds = np.frombuffer(row.folds, np.uint8)
        self.lengths = np.frombuffer(row.lengths, np.uint32).astype(np.int64)
        vocabulary = np.cumsum(unpack(row.words, np.uint64), dtype=np.uint64)
        tokens = vocabulary[unpack(row.tokens, np.uint32)]
        before = np.concatenate([np.array([END], np.uint64), tokens[:-1]])  # a document follows the end of the one before it
        pairs = mix64(before * np.uint64(0xD6E8FEB86659FD93) + tokens) | ODD
        self.keys = np.unique(np.concatenate([vocabulary, np.array([END], np.uint64), pairs]))
        self.word = np.searchsorted(self.keys, tokens)
        self.context = np.concatenate([[np.searchsorted(self.keys, END)], self.word[:-1]])
        self.pair = np.searchsorted(self.keys, pairs)
        self.fold = np.repeat(self.folds, self.lengths)

    def counts(self) -> np.ndarray:
        """Per key: occurrences in the folds that estimates are made of, and in the EM fold."""
        out = np.zeros((2, len(self.keys)), np.uint32)
        for i, own in enumerate(((self.fold != HELD_OUT) & (self.fold != EM_FOLD), self.fold == EM_FOLD)):
            out[i] = np.bincount(self.word[own], minlength=len(self.keys)) + np.bincount(self.pair[own], minlength=len(self.keys))
        return out


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _grid(x: np.ndarray) -> np.ndarray:
    """Cell of a probability; -1 for 0."""
    return np.where(x > 0, np.round(-np.log2(np.maximum(x, 1e-30)) * GRID), -1).astype(np.int64)


def _cell(q: np.ndarray) -> np.ndarray:
    return np.where(q < 0, 0.0, 2.0 ** (-q / GRID))


def histogram(frame_rows, total: float) -> pd.DataFrame:
    """Tokens of the EM fold by frequency bucket of the context and by both estimates from the other folds."""
    parts = []
    for row in frame_rows:
        own = Tokens(row)
        counts = gathered(((p["bucket"], p["totals"]) for p in row.answers), 2)[0].astype(np.float64)
        context = counts[own.context]
        two = np.divide(counts[own.pair], context, out=np.zeros(len(context)), where=context > 0)
        one = counts[own.word] / max(total, 1.0)
        parts.append(np.stack([frequency_bucket(context), _grid(two), _grid(one)], 1))
    cells, n = np.unique(np.concatenate(parts) if parts else np.zeros((0, 3), np.int64), axis=0, return_counts=True)
    return pd.DataFrame({"b": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": n})


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Per frequency bucket the weights of the pair, word and uniform estimates."""
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    weights[0] = (0.0, 0.7, 0.3)
    for b, own in cells.groupby("b"):
        n = own["n"].to_numpy(float)
        p = np.stack([_cell(own["two"].to_numpy()), _cell(own["one"].to_numpy()), np.full(len(own), uniform)], 1)
        w = weights[b].copy()
        for _ in range(rounds):
            share = w * p
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def score_rows(frame_rows, weights: np.ndarray, total: int, distinct: int) -> Iterator[pd.DataFrame]:
    uniform = 1.0 / (distinct + 1)
    for row in frame_rows:
        own = Tokens(row)
        counts = gathered(((p["bucket"], p["totals"]) for p in row.answers), 2).sum(0).astype(np.float64)
        context, word = counts[own.context], counts[own.word]
        two = np.divide(counts[own.pair], context, out=np.zeros(len(context)), where=context > 0)
        w = weights[frequency_bucket(context)]
        p = w[:, 0] * two + w[:, 1] * word / max(total, 1) + w[:, 2] * uniform
        starts = np.concatenate([[0], np.cumsum(own.lengths)[:-1]])
        base = np.add.reduceat(np.log10(word + 0.1), starts) - own.lengths * math.log10(total + 0.1 * (distinct + 1))
        out = pd.DataFrame({"held_out": own.folds == HELD_OUT, "n_tokens": own.lengths, "n_known": np.add.reduceat((word > 0).astype(np.int64), starts)})
        out["train_tokens"], out["base_score"], out["score"] = total, base, np.add.reduceat(np.log10(p), starts)
        ids = pd.array(own.ids, dtype="Int64")
        ids[own.missing] = pd.NA
        out.insert(0, "doc_id", ids)
        yield out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(text.mapInPandas(make_blocks, BLOCK_SCHEMA), "lm-blocks")
    n_buckets = pieces(2 * (blocks.agg(F.sum("n_tokens")).first()[0] or 0), KEYS_PER_BUCKET)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Tokens(row)
                yield requests(own.block, own.keys, own.counts(), n_buckets)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rest = em = 0
            for row in frame.itertuples():
                folds, lengths = np.frombuffer(row.folds, np.uint8), np.frombuffer(row.lengths, np.uint32)
                rest += int(lengths[(folds != HELD_OUT) & (folds != EM_FOLD)].sum())
                em += int(lengths[folds == EM_FOLD].sum())
            yield pd.DataFrame({"rest": [rest], "em": [em]})

    sizes = blocks.select("folds", "lengths").mapInPandas(train, "rest long, em long").agg(F.sum("rest"), F.sum("em")).first()
    rest, em = (int(x or 0) for x in sizes)
    asked = blocks.drop("em", "n_tokens").mapInPandas(ask, REQUEST).repartition(n_buckets, "bucket")  # a task per bucket, whatever the size
    answers = stored(answered(asked, 2), "lm-answers")
    distinct = int(answers.agg(F.sum("distinct_even")).first()[0] or 0)
    by_block = answers.repartition(max(1, blocks.count()), "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield histogram(frame.itertuples(), rest)

    evidence = blocks.filter("em").drop("em", "n_tokens").join(by_block, "block").mapInPandas(cells, "b long, two long, one long, n long")
    grid = evidence.groupBy("b", "two", "one").agg(F.sum("n").alias("n")).orderBy("b", "two", "one").toPandas()
    weights = learn_weights(grid, 1.0 / (distinct + 1))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from score_rows(frame.itertuples(), weights, rest + em, distinct)

    return blocks.drop("em", "n_tokens").join(by_block, "block").mapInPandas(scored, SCORE_SCHEMA)

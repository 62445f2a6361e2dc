"""Exact n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

All shingles of the corpus are ordered by the number of documents that hold them, the rarest first, ties by hash. Two
sets with a similarity of PERCENT or more have a common shingle within the first n - ceil(PERCENT * n / 100) + 1 places of
either one's order, so documents are joined on the shingles of these prefixes. A pair that meets there goes on only if
its sizes allow the similarity (length), if what is left after the places where it meets does (positional), and if the
shares of eight hash classes among the shingles after these places do (suffix: the differences of the classes' sizes
bound the number of shingles that only one side has). What is left is verified on full sets, once per pair.

Documents of equal sets form one class before anything is joined. Counts of documents per shingle come from blocks of
documents and buckets of the key space: a block asks each bucket for its shingles, with the documents that hold them
where a shingle occurs once in the block, otherwise with a count only; a bucket answers with those that other classes
have too. Shingles of one class only come first in the order and meet nothing, so a document with more than
100 - PERCENT percent of them is done. An answer never grows with a hot shingle's documents, only with its blocks.

The result is components, so links inside a large group need not all be made: under a shingle, classes are first
compared with one central class (links grow with the rows, not with their square), links are verified and components
formed. For shingles whose classes are then in several components, all pairs across components pass the filters, dealt
in blocks; no link between components is lost.

Defined cases: texts without words (null and empty ones too) have empty sets and link with nothing; a text of fewer words
than a shingle has its whole sequence as its one shingle; rows that repeat a doc_id are one node with the links of all
its texts; a row without doc_id links with nothing and has no component; texts of any length are one set each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, text_batches
from .components import connected_components
from .keycounts import bucket_bounds, pack, unpack
from .keyfilter import joined_in_slices, only_likely
from .shingles import SET_CHUNK_BYTES, as_bytes, chunks, word_shingles

WIDTH, PERCENT = 3, 90
BLOCK_SHINGLES, KEYS_PER_BUCKET = 1 << 20, 1 << 20
CLASSES = 8  # of shingles, in the suffix filter
DEALT = 2048  # rows of a shingle in one block when pairs across components are made
MEMBER_SCHEMA = "doc_id long, n_shingles long, digest binary"
MESSAGE = "kind int, bucket long, block long, keys binary, docs binary, dfs binary, folded binary, counts binary"
COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]
ASKS, HOLDS, IS, ANSWERS = range(4)
SET_SCHEMA = "rep long, digest binary, n long, s long, shingles binary"
SUFFIX = [f"q{i}" for i in range(CLASSES)]


def _sets(frame: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row of the frame, sorted distinct shingles and their digest."""
    for first, part in chunks(as_bytes(frame["text"]), SET_CHUNK_BYTES):
        values, n = word_shingles(part, width)
        at = 0
        for i, k in enumerate(n):
            own = np.unique(values[at : at + k])
            at += k
            yield first + i, own, hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _members(width: int) -> Callable:
    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(len(own), digest) for _, own, digest in _sets(frame, width)]
            out = pd.DataFrame(rows, columns=["n_shingles", "digest"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return members


class _Block:
    """Sets of documents that ask together."""

    def __init__(self):
        self.ids, self.digests, self.sets, self.size = [], [], [], 0

    def add(self, doc_id: int, own: np.ndarray, digest: bytes) -> None:
        self.ids.append(doc_id)
        self.digests.append(digest)
        self.sets.append(own)
        self.size += len(own)

    def messages(self, block: int, n_buckets: int) -> pd.DataFrame:
        sizes = np.array([len(s) for s in self.sets], np.uint32)
        keys, docs = np.concatenate(self.sets), np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        counts = np.diff(np.append(np.flatnonzero(head), len(keys)))
        once = np.repeat(counts == 1, counts)
        values, alone = keys[head], counts == 1
        own = (block, -1 - block)
        rows = [(IS, own[1], block, np.array(self.ids, np.int64).tobytes(), sizes.tobytes(), b"".join(self.digests), b"", b"")]
        if not once.all():
            rows.append((HOLDS, own[1], block, pack(np.diff(keys[~once], prepend=np.uint64(0))), pack(docs[~once]), b"", b"", b""))
        single, single_docs, folded, n = values[alone], docs[once], values[~alone], counts[~alone].astype(np.uint32)
        a, b = bucket_bounds(single, n_buckets), bucket_bounds(folded, n_buckets)
        for i in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
            x, y = slice(a[i], a[i + 1]), slice(b[i], b[i + 1])
            rows.append((ASKS, int(i), block, _delta(single[x]), pack(single_docs[x]), b"", _delta(folded[y]), pack(n[y])))
        return pd.DataFrame(rows, columns=COLUMNS)


def _delta(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def _asks(width: int, n_buckets: int) -> Callable:
    def asks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            for i, own, digest in _sets(frame, width):
                if not len(own):
                    continue
                block.add(int(ids[i]), own, digest)
                if block.size >= BLOCK_SHINGLES:
                    yield block.messages(base + made, n_buckets)
                    block, made = _Block(), made + 1
        if block.size:
            yield block.messages(base + made, n_buckets)

    return asks


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to all blocks: their shingles that occur again somewhere, and in how many documents. What a block
    keeps for itself passes through."""
    if frame["kind"].iloc[0] != ASKS:
        return frame
    single, folded = [_keys(k) for k in frame["keys"]], [_keys(k) for k in frame["folded"]]
    counts = np.concatenate([np.ones(sum(map(len, single)), np.uint32), *[unpack(c, np.uint32) for c in frame["counts"]]])
    values, inverse = np.unique(np.concatenate(single + folded), return_inverse=True)
    df = np.bincount(inverse, counts, len(values)).astype(np.uint32)[inverse]
    rows, at, at_folded = [], 0, sum(map(len, single))
    for bucket, block, docs, own, many in zip(frame["bucket"], frame["block"], frame["docs"], single, folded):
        n, m = df[at : at + len(own)], df[at_folded : at_folded + len(many)]
        at, at_folded = at + len(own), at_folded + len(many)
        again = n > 1
        if again.any() or len(many):
            rows.append((ANSWERS, bucket, block, _delta(own[again]), pack(unpack(docs, np.uint32)[again]), pack(n[again]), _delta(many), pack(m)))
    return pd.DataFrame(rows, columns=COLUMNS)


def _assemble(percent: int) -> Callable:
    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        """A block's documents that can have a partner: their shared shingles, the rarest first."""
        (own,) = frame[frame["kind"] == IS].itertuples()
        ids, sizes = np.frombuffer(own.keys, np.int64), np.frombuffer(own.docs, np.uint32).astype(np.int64)
        answers = frame[frame["kind"] == ANSWERS].sort_values("bucket")
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *map(_keys, answers["keys"])])
        docs = np.concatenate([none, *[unpack(d, np.uint32) for d in answers["docs"]]]).astype(np.int64)
        dfs = np.concatenate([none, *[unpack(d, np.uint32) for d in answers["dfs"]]]).astype(np.int64)
        for held in frame[frame["kind"] == HOLDS].itertuples():
            values = np.concatenate([none, *map(_keys, answers["folded"])])
            totals = np.concatenate([none, *[unpack(c, np.uint32) for c in answers["counts"]]]).astype(np.int64)
            many = _keys(held.keys)
            keys, docs = np.concatenate([keys, many]), np.concatenate([docs, unpack(held.docs, np.uint32).astype(np.int64)])
            dfs = np.concatenate([dfs, totals[np.searchsorted(values, many)]])
        shared = np.bincount(docs, minlength=len(ids))
        order = np.lexsort((keys, dfs, docs))
        keys, ends = keys[order], np.cumsum(shared)
        kept = np.flatnonzero(100 * shared >= percent * sizes)
        rows = [(int(ids[i]), own.dfs[16 * i : 16 * i + 16], int(sizes[i]), int(shared[i]), keys[ends[i] - shared[i] : ends[i]].tobytes()) for i in kept]
        return pd.DataFrame(rows, columns=["rep", "digest", "n", "s", "shingles"])

    return assemble


def shared_sets(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """rep, n, s, shingles: the classes that have at least percent of their n shingles in common with any others; the s
    common ones, the rarest first."""
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = pieces(total, KEYS_PER_BUCKET)
    # a row that isn't its class's own but passes the bitmap only makes shingles look more frequent than they are
    own = only_likely(docs.filter("doc_id IS NOT NULL"), classes.select(F.col("rep").alias("doc_id")), ["doc_id"]).select("doc_id", "text")
    answers = own.mapInPandas(_asks(width, n_buckets), MESSAGE).repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(_answer, MESSAGE)
    sets = answers.repartition(n_buckets, "block").groupBy("block").applyInPandas(_assemble(percent), SET_SCHEMA)
    return stored(sets.join(classes.select("rep", "digest"), ["rep", "digest"]).dropDuplicates(["rep", "digest"]).drop("digest"), "join-sets")


def _prefixes(percent: int) -> Callable:
    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each shared shingle in a prefix: its place, and the hash classes of the shingles after it."""
        for frame in frames:
            parts = []
            for rep, n, s, blob in zip(frame["rep"], frame["n"], frame["s"], frame["shingles"]):
                k = n - -(-percent * n // 100) + 1 - (n - s)  # those of one class only come first
                if k > 0:
                    own = np.frombuffer(blob, np.uint64)
                    kind = (own >> np.uint64(61)).astype(np.int64)
                    before = np.cumsum(np.eye(CLASSES, dtype=np.int64)[kind[:k]], 0)
                    rows = np.empty((k, 4 + CLASSES), np.int64)
                    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = own[:k].view(np.int64), rep, n, n - s + np.arange(k)
                    rows[:, 4:] = np.bincount(kind, minlength=CLASSES) - before
                    parts.append(rows)
            if parts:
                yield pd.DataFrame(np.concatenate(parts), columns=["key", "rep", "n", "place", *SUFFIX])

    return prefixes


PREFIX_SCHEMA = "key long, rep long, n long, place long, " + ", ".join(f"{q} long" for q in SUFFIX)


def _passes(other: str, percent: int, first: bool) -> Column:
    """Length, positional and suffix filters for two rows of one shingle, the second one's columns ending in other. first:
    the shingle is taken for the pair's first common one, as it is under one shingle of each pair."""
    n1, at1, n2, at2 = (F.col(c) for c in ("n", "place", f"n{other}", f"place{other}"))
    before = F.lit(0) if first else F.least(at1, at2)
    left1, left2 = n1 - at1 - 1, n2 - at2 - 1
    differ = sum((F.abs(F.col(q) - F.col(f"{q}{other}")) for q in SUFFIX), F.lit(0))
    enough = lambda common: (100 + percent) * common >= percent * (n1 + n2)
    length = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return length & enough(before + 1 + F.least(left1, left2)) & enough(before + 1 + F.floor((left1 + left2 - differ) / 2))


def _verify(percent: int) -> Callable:
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for a, b, n, m in zip(frame["a"], frame["b"], frame["n_u"], frame["n_v"]):
                common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                ok.append(100 * common >= percent * (n + m - common))
            yield frame.loc[ok, ["u", "v"]]

    return verify


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """key, rep and the filters' columns of all rows whose shingle is in the prefix of another class too."""
    rows = stored(sets.mapInPandas(_prefixes(percent), PREFIX_SCHEMA), "join-prefixes")
    several = stored(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "join-keys")
    total, most = (x or 0 for x in several.agg(F.sum("m"), F.max("m")).first())
    return stored(joined_in_slices(rows, several, "key", "m", total, "rep", most), "join-candidates")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: enough verified links between classes to connect all that are connected."""
    met = candidates(sets, percent)
    total, most = (x or 0 for x in met.agg(F.count("*"), F.max("m")).first())

    def verified(pairs: DataFrame) -> DataFrame:
        for side, name in (("u", "a"), ("v", "b")):
            pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(name)), side)
        return pairs.mapInPandas(_verify(percent), "u long, v long")

    # the hub is the class whose shared shingles begin first and that has most after this place: the most central one
    central = F.struct("place", (-F.col("n")).alias("most"), F.col("rep").alias("hub"), F.col("n").alias("n_h"), F.col("place").alias("place_h"), *[F.col(q).alias(f"{q}_h") for q in SUFFIX])
    hubs = met.groupBy("key").agg(F.min(central).alias("h"), F.count("*").alias("m")).select("key", "m", "h.*").drop("place", "most")
    stars = joined_in_slices(met.drop("m"), hubs, "key", "m", total, "rep", most).filter((F.col("rep") != F.col("hub")) & _passes("_h", percent, False))
    stars = stored(stars.select(F.least("hub", "rep").alias("u"), F.greatest("hub", "rep").alias("v")).distinct(), "join-stars")
    found = stored(verified(stars), "join-links")
    placed = met.drop("m").join(connected_components(found), F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", "m")
    rest = joined_in_slices(placed, open_keys, "key", "m", total, "rep", most).withColumn("blocks", F.ceil(F.col("m") / DEALT).cast("int")).drop("m")
    rest = stored(rest.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "join-rest")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rest.withColumn("other", each)
    right = rest.select(*[F.col(c).alias(f"{c}2") for c in ("key", "own", "rep", "n", "place", *SUFFIX, "component")], each.alias("other2"))
    same = (F.col("key") == F.col("key2")) & (F.col("own") == F.col("other2")) & (F.col("other") == F.col("own2"))
    differ = (F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2"))
    pairs = left.join(right, same & differ & _passes("2", percent, True)).select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct()
    pairs = stored(pairs.join(stars, ["u", "v"], "left_anti"), "join-pairs")
    return found if pairs.isEmpty() else found.unionByName(verified(pairs))


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = stored(own.mapInPandas(_members(width), MEMBER_SCHEMA), "join-members")
    nodes = members.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")), "join-classes")
    # a doc_id with several texts ties their classes together; its class is named after the least doc_id of each
    several = nodes.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    tied = nodes.select("doc_id", "digest").distinct().join(several, "doc_id").join(classes.select("digest", "rep"), "digest")
    ties = tied.select(F.greatest("doc_id", "rep").alias("u"), F.least("doc_id", "rep").alias("v"))
    found = connected_components(links(shared_sets(own, classes, width, percent), percent).unionByName(ties)).withColumnRenamed("node", "rep")
    label = classes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = members.join(label, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))

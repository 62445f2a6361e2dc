"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their normalised content; inside a task a partition that does not fit the
memory bound is split again, by further hash bits, into spill files until each bucket fits an open-addressing
table whose probes compare complete contents.

Copies can hold a third of all rows, so each map task first folds equal contents within a bounded table and only
one record per distinct content and fold leaves it. Every document then finds its class by the content's SHA-256
(the table itself proves that equal digests mean equal contents and fails the job otherwise).

Defined cases: a null text counts as empty; texts of white space only equal the empty text; of equal texts the row
with the most code points stays, then the smallest doc_id; rows that repeat a doc_id are rows of their own and
are counted, and all rows with the kept doc_id are marked kept; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_BYTES, lean_memory, stored, text_batches
from .keyfilter import joined_in_slices, without

FOLD_BYTES = 48 << 20
BUCKET_BYTES = 96 << 20
FAN_OUT = 16


class ContentTable:
    """Open addressing with linear probing; a probe compares the complete content."""

    def __init__(self, slots: int = 1024):
        self.slots = [None] * slots
        self.used = 0
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, length: int, doc_id, count: int) -> None:
        if 3 * self.used >= 2 * len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (entry := self.slots[at]) is not None:
            if entry[1] == content:
                if prefer(length, doc_id, entry[2], entry[3]):
                    entry[2], entry[3] = length, doc_id
                entry[4] += count
                return
            if entry[0] == digest:
                raise ValueError("two different contents share a SHA-256 digest")
            at = (at + 1) & mask
        self.slots[at] = [digest, content, length, doc_id, count]
        self.used += 1
        self.bytes += len(content) + 300

    def _grow(self) -> None:
        old = [e for e in self.slots if e is not None]
        self.slots = [None] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry in old:
            at = int.from_bytes(entry[0][8:16], "little") & mask
            while self.slots[at] is not None:
                at = (at + 1) & mask
            self.slots[at] = entry

    def entries(self) -> Iterator[list]:
        return (e for e in self.slots if e is not None)


def prefer(length: int, doc_id, than_length: int, than_id) -> bool:
    """Longer originals first, then the smaller doc_id; a null doc_id comes last."""
    if length != than_length:
        return length > than_length
    return doc_id is not None and (than_id is None or doc_id < than_id)


def _batches(entries: Iterator[list], with_content: bool, limit: int = 8 << 20) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for e in entries:
        rows.append(e)
        size += len(e[1]) + 100
        if size >= limit:
            yield _frame(rows, with_content)
            rows, size = [], 0
    if rows:
        yield _frame(rows, with_content)


def _frame(rows: list[list], with_content: bool) -> pd.DataFrame:
    out = {"digest": [r[0] for r in rows]}
    if with_content:
        out["content"] = [r[1] for r in rows]
        out["length"] = [r[2] for r in rows]
    out["keep_id"] = pd.array([r[3] for r in rows], dtype="Int64")
    out["group_size"] = [r[4] for r in rows]
    return pd.DataFrame(out)


def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map side: normalises and folds equal contents within a table of bounded size."""
    lean_memory()
    held = ContentTable()
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
            text = text if isinstance(text, str) else ""
            content = text.encode("utf-8", "surrogatepass").translate(None, WS_BYTES)
            held.add(hashlib.sha256(content).digest(), content, len(text), None if pd.isna(doc_id) else int(doc_id), 1)
            if held.bytes > FOLD_BYTES:
                yield from _batches(held.entries(), True)
                held = ContentTable()
    yield from _batches(held.entries(), True)


def grace(records: Iterator[tuple], depth: int = 0, limit: int = BUCKET_BYTES) -> Iterator[list]:
    """Fills one table; past the limit all records go to spill files by the next hash bits, and each is done alike."""
    held = ContentTable()
    for record in records:
        held.add(*record)
        if held.bytes > limit and held.used > 1 and depth < 16:
            break
    else:
        yield from held.entries()
        return
    with tempfile.TemporaryDirectory() as folder:
        files = [open(os.path.join(folder, str(i)), "wb") for i in range(FAN_OUT)]  # noqa: SIM115
        try:
            for record in held.entries():
                pickle.dump(tuple(record), files[_slot(record[0], depth)], 5)
            del held
            for record in records:
                pickle.dump(record, files[_slot(record[0], depth)], 5)
        finally:
            for f in files:
                f.close()
        for i in range(FAN_OUT):
            path = os.path.join(folder, str(i))
            yield from grace(_spilled(path), depth + 1, limit)
            os.unlink(path)


def _slot(digest: bytes, depth: int) -> int:
    return digest[16 + depth // 2] >> 4 * (depth % 2) & 15


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side: Grace recursion over one hash partition."""
    lean_memory()

    def records() -> Iterator[tuple]:
        for frame in frames:
            for d, c, n, k, s in zip(frame["digest"], frame["content"], frame["length"], frame["keep_id"].astype(object), frame["group_size"]):
                yield bytes(d), bytes(c), int(n), None if pd.isna(k) else int(k), int(s)

    yield from _batches(grace(records()), False)


def content_classes(docs: DataFrame) -> DataFrame:
    """digest binary, keep_id long, group_size long: one row per distinct normalised content."""
    text_batches(docs.sparkSession)
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        fold, "digest binary, content binary, length long, keep_id long, group_size long"
    )
    return folded.repartition("digest").mapInPandas(unite, "digest binary, keep_id long, group_size long")


def normalised_digest(text: str = "text"):
    """SHA-256 of the normalised text, as lower-case hex, on the JVM."""
    return F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), " \t\n\x0b\x0c\r", ""), 256)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised_digest().alias("text_sha256"))
    classes = stored(content_classes(docs).select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size"), "exact-classes")
    total, most = (x or 0 for x in classes.agg(F.sum("group_size"), F.max("group_size")).first())
    return joined_in_slices(members, classes, "text_sha256", "group_size", total, "doc_id", most).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the documents that stay, with their own columns; a repeated row stays once. Where doc_ids are
    unique, the ids that go decide and texts aren't shuffled again; only rows whose doc_id is null or repeats are
    joined by content."""
    members = docs.select(F.col("doc_id").cast("long").alias("__id"), normalised_digest().alias("__digest"))
    classes = stored(content_classes(docs).select(F.lower(F.hex("digest")).alias("__class"), F.col("keep_id").alias("__keep_id")), "exact-classes")
    same = (F.col("__digest") == F.col("__class")) & F.col("__id").eqNullSafe(F.col("__keep_id"))
    ids = stored(members.join(classes, same, "left").groupBy("__id").agg(F.count("*").alias("n"), F.count("__class").alias("stay")), "exact-ids")
    key = F.col("doc_id").cast("long")
    rest = without(docs.filter(key.isNotNull()), key, ids.filter("__id IS NOT NULL AND (n > 1 OR stay = 0)").select("__id"))
    several = ids.filter("__id IS NULL OR n > 1").select(F.col("__id").alias("__several"))
    if several.isEmpty():
        return rest
    own = docs.join(several, key.eqNullSafe(F.col("__several")), "left_semi").withColumns({"__id": key, "__digest": normalised_digest()})
    # what is left of a class is one doc_id, so these windows hold more than one row only where a doc_id repeats
    one = Window.partitionBy("__digest", "__keep_id").orderBy(F.desc(F.length("text")), "text")
    repeated = own.join(classes, same).withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return rest.unionByName(repeated)

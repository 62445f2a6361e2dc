"""Removal of repeated substrings by a common-prefix-aware distributed merge sort.

A byte goes if it lies in a string of LENGTH bytes that starts at two or more places of the corpus. Sorting a suffix
for every byte would move hundreds of bytes per byte, so as in the published prefix-doubling string sorters, hashes first
tell which suffixes can have a partner at all:

1. Each window of LENGTH bytes has an anchor, its GRAM-byte piece of least hash (the first on a tie). Equal
   windows have equal anchors at equal places, so a window whose anchor's piece occurs once in the corpus is unique.
2. For the others, the windows of one anchor in a row are one suffix, cut where their last window ends. The
   suffixes of a task are sorted, equal ones folded to one, and front-coded: that is a run. Runs are cut at sampled
   splitters, exchanged, and merged by loser trees that never compare a known prefix again. A suffix whose longest
   common prefix with a neighbour is its whole length has all its windows repeated. What is the same in one
   run travels once, so copies of any number make no task larger than one entry per run.
3. What is left are the edges of repeated passages, where only some of a suffix's windows are repeated. Their windows
   meet as sorted runs of 96-bit fingerprints, beside those of whole suffixes with the same anchor.

Defined cases: a null text is empty; texts below LENGTH bytes and empty ones lose nothing; rows that repeat a doc_id
are texts of their own (equal rows repeat each other wholly); strings are judged on the input; an empty table gives
an empty result; other columns are ignored. A text has at most 2^30 bytes (Spark's own limit of a batch is near); a
longer one raises an error.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, text_batches
from .frontcoded import decode, encode, merge
from .keycounts import bucket_bounds, pack, unpack
from .keyfilter import divided, only_likely
from .shingles import _powers, as_bytes, chunks, mix64

LENGTH, GRAM = 400, 128
POSITION_BITS = 30
RUN_BYTES = 12 << 20
FOLDED_BYTES = 64  # what a folded copy holds in memory
PART_BYTES = 16 << 20
SAMPLES_PER_PART = 8
#: Parts of one level: their splitters, of LENGTH bytes at most, and the sample that they are drawn from go through the driver.
MOST_PARTS = 2048
#: A piece is hot if it makes up more than one in so many anchors; there are fewer hot pieces than that.
HOT_SHARE = 20_000
BLOCK_WINDOWS = 1 << 18
KEYS_PER_BUCKET = 1 << 20


def _sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw))[0], dtype=np.uint64)])


def _hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every piece of so many bytes."""
    n = len(sums) - width
    return (sums[width:] - sums[:-width]) * _powers(len(sums))[1][:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every window: by running minima of blocks, forwards and backwards."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Per anchor with its windows in a row: index of the text, hash of the piece, first and last window."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) >= 1 << POSITION_BITS:
        raise ValueError(f"a text has {len(raw)} bytes; positions have {POSITION_BITS} bits")
    bounds = np.cumsum([0] + [len(t) for t in texts])
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = mix64(_hashes(_sums(raw), gram))
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    piece = (least & low).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(len(piece)), "right") - 1
    whole = np.arange(len(piece)) + length <= bounds[doc + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.concatenate([[True], (np.diff(starts) != 1) | (piece[starts[1:]] != piece[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])])
    first = starts[new]
    last = np.concatenate([starts[np.flatnonzero(new)[1:] - 1], starts[-1:]])
    own = doc[first]
    return own, hashes[piece[first]].view(np.int64), first - bounds[own], last - bounds[own]


def _anchor_rows(length: int, gram: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, marks = frame["id"].array, frame["mark"].to_numpy()
            for start, part in chunks(as_bytes(frame["text"])):
                own, piece, first, last = anchors(part, length, gram)
                if len(own):
                    yield pd.DataFrame({"piece": piece, "id": ids[own + start], "mark": marks[own + start], "a": first.astype(np.int32), "b": last.astype(np.int32)})

    return rows


class Run:
    """Suffixes of one task until the bound; equal ones fold to the first, and all of them then are known to repeat."""

    def __init__(self, length: int):
        self.first, self.again, self.size, self.length = {}, [], 0, length

    def add(self, suffix: bytes, owner: tuple) -> None:
        if (seen := self.first.get(suffix)) is None:
            self.first[suffix] = [owner, False]
            self.size += len(suffix)
        else:
            self.size += FOLDED_BYTES
            if not seen[1]:
                self.again.append(seen[0][:4])
                seen[1] = True
            self.again.append(owner[:4])

    def row(self) -> dict:
        strings = sorted(self.first)
        owners = np.array([self.first[s][0] for s in strings], np.int64).reshape(-1, 5)
        folded = np.array([self.first[s][1] for s in strings], np.uint8)
        return {
            "n": len(strings), "size": sum(map(len, strings)), "strings": encode(strings), "owners": pack(owners.T.reshape(-1)), "folded": folded.tobytes(),
            "again": pack(np.array(self.again, np.int64).reshape(-1, 4).T.reshape(-1)), "sample": [s[: self.length] for i, s in enumerate(strings) if i % 64 == 32],
        }


RUN_SCHEMA = "n long, size long, strings binary, owners binary, folded binary, again binary, sample array<binary>"


def _make_runs(length: int):
    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = Run(length)
        for frame in frames:
            for doc_id, mark, text, spans in zip(frame["id"], frame["mark"], as_bytes(frame["text"]), frame["spans"]):
                for piece, a, b in sorted({(s["piece"], s["a"], s["b"]) for s in spans}, key=lambda s: s[1]):
                    run.add(text[a : b + length], (doc_id, mark, a, b, piece))
                if run.size >= RUN_BYTES:
                    yield pd.DataFrame([run.row()])
                    run = Run(length)
        if run.first:
            yield pd.DataFrame([run.row()])

    return runs


def _cut(row, splitters: list[bytes]) -> Iterator[tuple]:
    """A run's slices: number, strings, owners, folded. Strings that are equal in their first LENGTH bytes stay together,
    as no splitter is longer."""
    strings, shared = decode(row.strings)
    owners, folded = unpack(row.owners, np.int64).reshape(5, -1), np.frombuffer(row.folded, np.uint8)
    at = [0] + [bisect.bisect_left(strings, s) for s in splitters] + [len(strings)]
    for part, (i, j) in enumerate(zip(at, at[1:])):
        if i < j:
            yield part, encode(strings[i:j], shared[i:j]), pack(owners[:, i:j].reshape(-1)), folded[i:j].tobytes()


CUT_SCHEMA = "part long, strings binary, owners binary, folded binary"
CUT_COLUMNS = ["part", "strings", "owners", "folded"]


def _cut_runs(splitters: list[bytes]):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                for piece in _cut(row, splitters):
                    yield pd.DataFrame([piece], columns=CUT_COLUMNS)

    return cut


def _cut_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts the slices of a part at the part's own splitters."""
    for frame in frames:
        for row in frame.itertuples():
            for sub, *rest in _cut(row, [bytes(s) for s in row.splitters] if row.splitters is not None else []):
                yield pd.DataFrame([(row.part * MOST_PARTS + sub, *rest)], columns=CUT_COLUMNS)


def _place(splitters: list[bytes]):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"part": [bisect.bisect_right(splitters, bytes(s)) for s in frame["s"]], "s": frame["s"]})

    return place


def _spread(drawn: list[bytes], n_parts: int) -> list[bytes]:
    return sorted({drawn[i * len(drawn) // n_parts] for i in range(1, n_parts)}) if drawn else []


def _own_splitters(n_parts: int):
    def own(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "splitters": [_spread(sorted(bytes(s) for s in frame["s"]), n_parts)]})

    return own


def _parts(runs: DataFrame) -> DataFrame:
    """Slices of the runs by part. Beyond MOST_PARTS parts they are cut twice: by splitters that go through the
    driver, and by those that the executors draw for each part."""
    n_parts = pieces(runs.agg(F.sum("size")).first()[0] or 0, PART_BYTES)
    sample = runs.select(F.explode("sample").alias("s"))
    total = max(1, sample.count())
    chance = lambda n: F.pmod(F.xxhash64("s"), F.lit(1 << 20)) < min(1.0, SAMPLES_PER_PART * n / total) * (1 << 20)
    first = min(n_parts, MOST_PARTS)
    splitters = _spread(sorted(bytes(r["s"]) for r in sample.filter(chance(first)).collect()), first)
    cut = runs.select("strings", "owners", "folded").mapInPandas(_cut_runs(splitters), CUT_SCHEMA)
    if n_parts <= MOST_PARTS:
        return cut
    each = min(MOST_PARTS, pieces(n_parts, MOST_PARTS))
    drawn = sample.filter(chance(n_parts)).mapInPandas(_place(splitters), "part long, s binary")
    own = drawn.groupBy("part").applyInPandas(_own_splitters(each), "part long, splitters array<binary>")
    return cut.join(own, "part", "left").mapInPandas(_cut_parts, CUT_SCHEMA)


MERGED_SCHEMA = "id long, mark int, a int, b int, piece long, whole boolean, suffix binary"


def _merge_part(frame: pd.DataFrame) -> pd.DataFrame:
    """Merges a part's runs. Of a suffix that repeats as a whole one copy is handed on, of the others all."""
    runs = [decode(s) for s in frame["strings"]]
    owners = [unpack(o, np.int64).reshape(5, -1) for o in frame["owners"]]
    folded = [np.frombuffer(f, np.uint8) for f in frame["folded"]]
    order = list(merge(runs))
    rows = []
    for at, (r, i, before) in enumerate(order):
        after = order[at + 1][2] if at + 1 < len(order) else 0
        suffix = runs[r][0][i]
        again = bool(folded[r][i])
        whole = again or max(before, after) >= len(suffix)
        same = at > 0 and before == len(suffix) == len(runs[order[at - 1][0]][0][order[at - 1][1]])
        rows.append((*owners[r][:, i].tolist(), whole, None if same else suffix))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED_SCHEMA.split(", ")])


def window_prints(suffix: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every window's fingerprint."""
    raw = np.frombuffer(suffix, np.uint8)
    first = _hashes(_sums(raw), length)
    second = _hashes(_sums(raw ^ np.uint8(0x5A)), length)
    return mix64(first), (mix64(second ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(32)).astype(np.uint32)


EDGE_SCHEMA = "bucket long, keys binary, checks binary, owner binary, place binary, known binary, owners binary, again binary"


def _spans_of(owners: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows id, mark, a, b: runs of the windows at these places of these owners. owners: id, mark, a, whole."""
    start = owners[2][owner] + place
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if not len(owner):
        return np.zeros((4, 0), np.int64)
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(start) > 1)])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(owner) - 1]])
    return np.stack([owners[0][owner[new]], owners[1][owner[new]], start[new], start[ends]])


def _edge_windows(length: int, n_buckets: int):
    """Sorted runs of fingerprints, cut at the buckets' bounds. A window that a block holds several times is known to
    repeat: its spans are noted here (again), and only one entry is sent, so that copies of any number cost a
    bucket one entry per block. Suffixes that repeat as a whole come along only to be met."""

    def emit(held: list[tuple]) -> Iterator[pd.DataFrame]:
        prints = [window_prints(h[3], length) for h in held]
        keys, checks = (np.concatenate([p[i] for p in prints]) for i in (0, 1))
        sizes = [len(p[0]) for p in prints]
        owner, place = np.repeat(np.arange(len(held)), sizes), np.concatenate([np.arange(s) for s in sizes])
        order = np.lexsort((checks, keys))
        keys, checks, owner, place = keys[order], checks[order], owner[order], place[order]
        owners = np.array([(*h[:3], h[4]) for h in held], np.int64).reshape(-1, 4).T
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])
        known = np.diff(np.append(np.flatnonzero(first), len(keys))) > 1
        local = np.repeat(known, np.diff(np.append(np.flatnonzero(first), len(keys)))) & (owners[3][owner] == 0)
        again = pack(_spans_of(owners, owner[local], place[local]).reshape(-1))
        keys, checks, owner, place = keys[first], checks[first], owner[first], place[first]
        bounds = bucket_bounds(keys, n_buckets)
        for b in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[b], bounds[b + 1])
            used, mine = np.unique(owner[own], return_inverse=True)
            yield pd.DataFrame({
                "bucket": [int(b)], "keys": [pack(np.diff(keys[own], prepend=np.uint64(0)))], "checks": [pack(checks[own])], "owner": [pack(mine.astype(np.uint32))],
                "place": [pack(place[own].astype(np.uint32))], "known": [np.packbits(known[own]).tobytes()], "owners": [pack(owners[:, used].reshape(-1))], "again": [again],
            })
            again = None

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for r in frame.itertuples():
                held.append((r.id, r.mark, r.a, bytes(r.suffix), int(r.whole)))
                size += len(r.suffix) - length + 1
                if size >= BLOCK_WINDOWS:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return rows


SPAN_SCHEMA = "id long, mark int, a int, b int"


def _repeated_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows of edges whose fingerprint another block has too, and the spans that the blocks found by themselves."""
    keys = np.concatenate([np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in frame["keys"]])
    checks = np.concatenate([unpack(c, np.uint32) for c in frame["checks"]])
    owners = [unpack(o, np.int64).reshape(4, -1) for o in frame["owners"]]
    base = np.cumsum([0] + [o.shape[1] for o in owners])
    local = [unpack(o, np.uint32).astype(np.int64) for o in frame["owner"]]
    known = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=len(o)).astype(bool) for k, o in zip(frame["known"], local)])
    owner = np.concatenate([o + base[i] for i, o in enumerate(local)])
    place = np.concatenate([unpack(p, np.uint32) for p in frame["place"]]).astype(np.int64)
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    equal = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    again = np.zeros(len(k), bool)
    again[1:] |= equal
    again[:-1] |= equal
    owners = np.concatenate(owners, axis=1)
    at = order[again]
    at = at[~known[at] & (owners[3][owner[at]] == 0)]
    found = np.concatenate([_spans_of(owners, owner[at], place[at]), *[unpack(b, np.int64).reshape(4, -1) for b in frame["again"] if b is not None]], axis=1)
    return pd.DataFrame({"id": found[0], "mark": found[1].astype(np.int32), "a": found[2].astype(np.int32), "b": found[3].astype(np.int32)})


def _again_spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for blob in frame["again"]:
            own = unpack(blob, np.int64).reshape(4, -1)
            yield pd.DataFrame({"id": own[0], "mark": own[1].astype(np.int32), "a": own[2].astype(np.int32), "b": own[3].astype(np.int32)})


def _identified(docs: DataFrame) -> DataFrame:
    """id, mark (tells texts of one doc_id apart; a null doc_id is -2^63), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.hash(text).alias("mark"), text.alias("text"))


def _repeated_anchors(found: DataFrame) -> DataFrame:
    """The anchors whose piece occurs again. Rows of hot pieces, of which there is a bounded number, aren't shuffled."""
    counts = stored(found.groupBy("piece").agg(F.count("*").alias("n")).filter("n > 1"), "sub-pieces")
    least = pieces(counts.agg(F.sum("n")).first()[0] or 0, HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col("n") > least).select("piece"))
    cold = found.join(hot, "piece", "left_anti").join(counts.filter(F.col("n") <= least).select("piece"), "piece")
    return found.join(hot, "piece", "left_semi").unionByName(cold)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, mark, a, b: runs of window starts, all of whose windows are repeated. docs as _identified() gives them."""
    found = stored(docs.filter(F.octet_length("text") >= length).mapInPandas(_anchor_rows(length, gram), "piece long, id long, mark int, a int, b int"), "sub-anchors")
    near = stored(_repeated_anchors(found).groupBy("id", "mark").agg(F.collect_list(F.struct("piece", "a", "b")).alias("spans")), "sub-near")
    texts = only_likely(docs, near, ["id", "mark"]).join(near, ["id", "mark"])
    runs = stored(texts.mapInPandas(_make_runs(length), RUN_SCHEMA), "sub-runs")
    merged = stored(_parts(runs).groupBy("part").applyInPandas(_merge_part, MERGED_SCHEMA), "sub-merged")
    spans = merged.filter("whole").select("id", "mark", "a", "b").unionByName(runs.select("again").mapInPandas(_again_spans, SPAN_SCHEMA))
    edge = merged.filter("NOT whole")
    beside = merged.filter("whole AND suffix IS NOT NULL").join(edge.select("piece").distinct(), "piece", "left_semi")
    n_windows = edge.unionByName(beside).agg(F.sum(F.octet_length("suffix") - length + 1)).first()[0] or 0
    emitted = edge.unionByName(beside).select("id", "mark", "a", "suffix", "whole").mapInPandas(_edge_windows(length, pieces(n_windows, KEYS_PER_BUCKET)), EDGE_SCHEMA)
    return spans.unionByName(emitted.groupBy("bucket").applyInPandas(_repeated_windows, SPAN_SCHEMA))


def union_of(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of runs of window starts."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [tuple(r) for r in out]


def _removed(length: int):
    def removed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, spans in zip(as_bytes(frame["text"]), frame["spans"]):
                ranges = union_of([(s["a"], s["b"]) for s in spans] if spans is not None else [], length)
                at, kept = 0, []
                for a, b in ranges:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(left), len(ranges), hashlib.sha256(left).hexdigest(), left, [{"start": a, "end": b} for a, b in ranges]))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])
            out.insert(0, "id", frame["id"])
            yield out

    return removed


DONE_SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), removed (byte ranges). Only texts that
    change are shuffled, and those that a bitmap of these lets through."""
    text_batches(docs.sparkSession)
    own = _identified(docs)
    spans = repeated_spans(own, length, gram).groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = stored(spans, "sub-spans")
    likely, same = divided(own, spans, ["id", "mark"])
    changed = likely.join(spans, ["id", "mark"], "left").mapInPandas(_removed(length), DONE_SCHEMA)
    none = F.array().cast("array<struct<start:long,end:long>>")
    same = same.select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"), none.alias("removed"),
    )
    out = changed.unionByName(same)
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")

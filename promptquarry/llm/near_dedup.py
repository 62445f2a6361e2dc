"""MinHash near-duplicate groups by a multi-index Hamming join.

A document's signature holds SYMBOLS MinHash values of b bits each over its set of word shingles. The signature is split
into CHUNKS chunks. By pigeonhole, two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have
a chunk with at most ERRORS differing ones; every way to leave ERRORS symbols of a chunk out gives an index key, so
all pairs within that distance meet under some key. At a similarity of 0.85 a pair differs in 4.8 of 32 symbols on
average and misses all of its keys with a chance of 2e-8; at 0.80, where the pipeline links, with one of 1.1e-6.

Documents of equal sets form one class before anything is paired. Under a key, classes are first compared with the
key's most central class only (links grow with the rows, not with their square), links are confirmed on full sets,
and components are formed. Keys whose classes then lie in one component are done: any further link there changes
nothing. For the rest all pairs of classes from different components are looked at in blocks, so no link between
components is lost, whatever the size of a key; a pair goes on to the comparison of full sets only if sizes, the
shingles that either shares with any class at all, and bit masks of both sets leave room for a link.

Defined cases: texts without words (null and empty ones too) have empty sets and link with nothing; a text of fewer
words than a shingle has its whole sequence as its one shingle; rows that repeat a doc_id are one node with the
links of all its texts; a row without doc_id links with nothing and stays; an empty table gives an empty result;
other columns are ignored by groups() and kept by the pipeline's stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, stored, text_batches
from .components import connected_components
from .keyfilter import joined_in_slices, only_likely, without
from .shingles import SET_CHUNK_BYTES, as_bytes, chunks, mix64, shingle_sets, word_shingles

SYMBOLS, CHUNKS, ERRORS = 32, 8, 1
PERCENT = 85
WIDTH = 5
BLOCK = 2048
MASKS = 8  # 64-bit words of a set's bit mask
_RNG = np.random.Generator(np.random.PCG64(20240101))
_XOR = _RNG.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, digest binary, signature binary"


def signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Set size, digest of the whole set and MinHash signature per document."""
    for frame in frames:
        texts, ids = as_bytes(frame["text"]), frame["doc_id"].array
        for start, part in chunks(texts, SET_CHUNK_BYTES):
            values, n = word_shingles(part, WIDTH)
            full = np.flatnonzero(n)
            at = np.concatenate([[0], np.cumsum(n)])
            symbols = np.zeros((len(part), SYMBOLS), np.uint32)
            if len(full):
                for j in range(SYMBOLS):
                    symbols[full, j] = np.minimum.reduceat((values ^ _XOR[j]) * _MUL[j], at[:-1][full]) >> np.uint64(32)
            sizes, digests = [], []
            for i in range(len(part)):
                own = np.unique(values[at[i] : at[i + 1]])
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            out = pd.DataFrame({"n_shingles": sizes, "digest": digests, "signature": [s.tobytes() for s in symbols]})
            out.insert(0, "doc_id", ids[start : start + len(part)])
            yield out


def index_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of each class: per chunk, one for every choice of ERRORS symbols left out."""
    lean_memory()
    size = SYMBOLS // CHUNKS
    kept = list(combinations(range(size), size - ERRORS))
    for frame in frames:
        if not len(frame):
            continue
        symbols = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, CHUNKS, size).astype(np.uint64)
        keys = np.empty((len(frame), CHUNKS, len(kept)), np.uint64)
        for c in range(CHUNKS):
            for v, at in enumerate(kept):
                key = np.full(len(frame), np.uint64(c * len(kept) + v))
                for i in at:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, c, i])
                keys[:, c, v] = key
        per = CHUNKS * len(kept)
        yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "rep": np.repeat(frame["rep"].to_numpy(), per)})


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = as_bytes(frame["text"])
        rows, size = [], 0
        for doc_id, own in zip(frame["rep"], shingle_sets(texts, WIDTH)):
            rows.append((doc_id, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own.tobytes()))
            size += own.nbytes
            if size > 8 << 20:
                yield pd.DataFrame(rows, columns=["rep", "digest", "shingles"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["rep", "digest", "shingles"])


def _confirm(percent: int):
    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_memory()
        for frame in frames:
            ok = []
            for a, b in zip(frame["a"], frame["b"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                common = int((y[at] == x).sum()) if len(y) else 0
                ok.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield frame.loc[ok, ["u", "v"]]

    return confirm


def _class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles (sorted uint64) of the wanted classes."""
    wanted = stored(wanted.distinct().join(classes.select("rep", "digest"), "rep"), "near-wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = only_likely(own.filter("rep IS NOT NULL"), wanted, ["rep"]).join(wanted.select("rep").distinct(), "rep")
    sets = texts.mapInPandas(_sets, "rep long, digest binary, shingles binary").join(wanted, ["rep", "digest"]).dropDuplicates(["rep", "digest"])
    return stored(sets.select("rep", "shingles"), "near-sets")


def _exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lean_memory()
    for frame in frames:
        sets = [np.frombuffer(blob, np.int64) for blob in frame["shingles"]]
        for i in range(0, len(sets), 256):
            part = sets[i : i + 256]
            yield pd.DataFrame({"shingle": np.concatenate(part), "rep": np.repeat(frame["rep"].to_numpy()[i : i + 256], [len(s) for s in part])})


def _masks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per set MASKS * 64 bits, one of them set by each shingle."""
    lean_memory()
    for frame in frames:
        bits = np.zeros((len(frame), MASKS * 64), np.uint8)
        for i, blob in enumerate(frame["shingles"]):
            bits[i, (np.frombuffer(blob, np.uint64) >> np.uint64(20)) % np.uint64(MASKS * 64)] = 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pd.DataFrame({"rep": frame["rep"], **{f"b{i}": words[:, i] for i in range(MASKS)}})


def _shared_sizes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, n, s: how many of a class's n shingles any other of these classes has. The rest can't be in a common part."""
    own = sets.mapInPandas(_exploded, "shingle long, rep long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("rep").alias("rep"))
    alone = own.filter("k = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    masks = sets.mapInPandas(_masks, "rep long, " + ", ".join(f"b{i} long" for i in range(MASKS)))
    rows = masks.join(classes.select("rep", F.col("n_shingles").alias("n")), "rep").join(alone, "rep", "left")
    return rows.select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"), *[f"b{i}" for i in range(MASKS)])


PROFILE = ["n", "s", *[f"b{i}" for i in range(MASKS)]]


def _possible(other: str, percent: int):
    """Whether the sets of two profiles (the second one's columns end in other) can be linked at all. The sizes must be
    within the threshold. The common part has at most the lesser s; and each bit that only one mask has stands for a
    shingle that only that set has."""
    n1, s1, n2, s2 = (F.col(c) for c in ("n", "s", f"n{other}", f"s{other}"))
    bits = [(F.col(f"b{i}"), F.col(f"b{i}{other}")) for i in range(MASKS)]
    only1 = sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in bits), F.lit(0))
    only2 = sum((F.bit_count(b.bitwiseAND(F.bitwise_not(a))) for a, b in bits), F.lit(0))
    enough = lambda common: (100 + percent) * common >= percent * (n1 + n2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & enough(F.least(s1, s2)) & enough(F.least(n1 - only1, n2 - only2))


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: enough confirmed links between classes (by their rep) to connect all that are connected."""
    keyed = classes.select("rep", "signature").mapInPandas(index_keys, "key long, rep long")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "near-shared")
    n_met, most = (n or 0 for n in shared.agg(F.sum("m"), F.max("m")).first())
    met = stored(joined_in_slices(keyed, shared, "key", "m", n_met, "rep", most), "near-keys")
    sets = _class_sets(docs, classes, met.select("rep"))
    sizes = stored(_shared_sizes(sets, classes).filter(100 * F.col("s") >= percent * F.col("n")), "near-sizes")
    met = met.drop("m").join(sizes, "rep")
    # the hub is the class with the least share of shingles of its own, which is the most central one
    central = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.col("rep").alias("hub"), *[F.col(c).alias(f"{c}_h") for c in PROFILE])
    hubs = met.groupBy("key").agg(F.min(central).alias("h"), F.count("*").alias("m")).select("key", "m", "h.*").drop("own")
    stars = joined_in_slices(met, hubs, "key", "m", n_met, "rep", most).filter((F.col("rep") != F.col("hub")) & _possible("_h", percent))
    stars = stored(stars.select(F.least("hub", "rep").alias("u"), F.greatest("hub", "rep").alias("v")).distinct(), "near-stars")

    def confirmed(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
        return wide.select("u", "v", "a", "b").mapInPandas(_confirm(percent), "u long, v long")

    first = stored(confirmed(stars), "near-links")
    component = connected_components(first)
    placed = met.join(component, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("left")).filter("lo < hi").select("key", "left")
    rest = joined_in_slices(placed, open_keys, "key", "left", n_met, "rep", most).select("key", "rep", *PROFILE, "component", F.ceil(F.col("left") / BLOCK).cast("int").alias("nb"))
    rest = stored(rest.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")), "near-rest")
    each = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = rest.withColumn("other", each)
    right = rest.select(*[F.col(c).alias(f"{c}2") for c in ("key", "own", "rep", *PROFILE, "component")], each.alias("other2"))
    same = (F.col("key") == F.col("key2")) & (F.col("own") == F.col("other2")) & (F.col("other") == F.col("own2"))
    differ = (F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2"))
    pairs = left.join(right, same & differ & _possible("2", percent)).select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct()
    pairs = stored(pairs.join(stars, ["u", "v"], "left_anti"), "near-pairs")
    return first if pairs.isEmpty() else first.unionByName(confirmed(pairs))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(own.mapInPandas(signatures, SIGNATURE_SCHEMA), "near-signatures")
    nodes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "near-classes"
    )
    reps = classes.select("digest", "rep")
    member = nodes.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep").distinct()
    # a doc_id with several texts ties their classes together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("w"), F.count("*").alias("k")).filter("k > 1").select("doc_id", "u")
    ties = member.join(several, "doc_id").select("u", F.col("rep").alias("v"))
    found = connected_components(links(own, classes, percent).unionByName(ties)).withColumnRenamed("node", "rep")
    label = reps.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.join(label, "digest", "left").withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The pipeline's stage: of each group the documents with its least doc_id stay, with their own columns."""
    gone = groups(docs, percent).filter("NOT kept").select("doc_id").distinct()
    return without(docs, F.col("doc_id").cast("long"), gone)

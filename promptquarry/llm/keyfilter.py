"""A filter ahead of a join: rows whose key surely has no partner don't reach the shuffle.

The keys' bitmap (one hash, a bit per cell) has a bounded size whatever the number of keys: past the bound it lets
more rows through, and the join that follows decides either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST_BITS, MOST_BITS = 16, 26
#: Keys that are broadcast at most, after they are counted.
BROADCAST_KEYS = 500_000
CELLS_PER_KEY = 16
#: A key is hot if more than SLICE rows and more than one in HOT_SHARE of all rows have it; fewer keys than that are.
HOT_SHARE, SLICE = 20_000, 50_000
PIECE = 1 << 16  # bits in one piece of the bitmap


def _with_words(rows: DataFrame, keys: DataFrame, columns: list[str], how: str) -> tuple[DataFrame, Column]:
    """rows with the piece of the keys' bitmap that holds their cell, and whether its bit is set. The bitmap has at most
    2^MOST_BITS bits; its pieces are joined by broadcast, so that no Python worker is needed beside those of other steps."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(n * CELLS_PER_KEY).bit_length()))

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << bits, bool)
        for frame in frames:
            own[frame["cell"].to_numpy()] = True
        parts = own.reshape(-1, PIECE)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"piece": some, "own": [np.packbits(parts[i], bitorder="little").tobytes() for i in some]}, columns=["piece", "own"])

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(b, "<i8") for b in frame["own"]])
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "words": [total]})

    cell = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    marked = keys.select(cell.alias("cell")).mapInPandas(mark, "piece long, own binary")
    bitmap = stored(marked.groupBy("piece").applyInPandas(unite, "piece long, words array<long>"), "bitmap").toDF("__bitmap_piece", "__bitmap_words")
    at = F.pmod(cell, F.lit(PIECE))
    is_set = F.bit_get(F.get("__bitmap_words", F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), F.floor(cell / PIECE) == F.col("__bitmap_piece"), how), F.coalesce(is_set, F.lit(False))


def only_likely(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key may be among the keys."""
    joined, likely = _with_words(rows, keys, columns, "inner")
    return joined.filter(likely).drop("__bitmap_piece", "__bitmap_words")


def divided(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the keys, and those whose key surely isn't."""
    joined, likely = _with_words(rows, keys, columns, "left")
    return tuple(joined.filter(x).drop("__bitmap_piece", "__bitmap_words") for x in (likely, ~likely))


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't in gone (one column of distinct longs, without nulls). Up to BROADCAST_KEYS keys are
    broadcast; beyond, only rows that the keys' bitmap lets through are shuffled."""
    gone = stored(gone.toDF("__gone"), "gone")
    if gone.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(gone), key == F.col("__gone"), "left_anti")
    likely, rest = divided(rows.withColumn("__gone", key), gone, ["__gone"])
    return rest.unionByName(likely.join(gone, "__gone", "left_anti")).drop("__gone")


def joined_in_slices(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int, by: str, most: int | None = None) -> DataFrame:
    """rows joined with per_key's one row per key; n is its column that counts the key's rows, total bounds the sum of n
    and most each n.
    Rows of a hot key are dealt over slices by a hash of their column by, and its row of per_key goes to each slice.
    Where no key can have more rows than a slice, the join is an ordinary one."""
    least = max(SLICE, -(-total // HOT_SHARE))
    if (total if most is None else most) <= least:
        return rows.join(per_key, key)
    slices = F.ceil(F.col(n) / least).cast("int")
    hot = F.broadcast(per_key.filter(F.col(n) > least).select(key, slices.alias("__slices")))
    dealt = rows.join(hot, key, "left").withColumn("__slice", F.pmod(F.xxhash64(by), F.coalesce("__slices", F.lit(1))).cast("int")).drop("__slices")
    return dealt.join(per_key.withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1))), [key, "__slice"]).drop("__slice")

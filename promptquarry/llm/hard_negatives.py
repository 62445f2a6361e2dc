"""Hard negatives by an exact dual-tree search over anchors and candidates.

Vectors become integers (SCALE times a component, rounded down), so that scores are exact. A coarse tree of at most CELLS
cells, split by planes that are fitted on a sample of SAMPLE_VALUES numbers, deals all rows to cells; what a cell holds is
packed in pieces of about PIECE rows, so a hot cell or many copies of one vector are several pieces. Each piece is a tree
of its own: nodes are split by label first, then between two far points, and know their centre, radius, labels and
least id. Anchors are packed likewise under a coarser cut of the same tree.

The inner product of any anchor of a node with any candidate of another lies in an interval around the product of the
centres. A pair of nodes is left out, for all of its anchors at once, if its interval can't reach any anchor's best
rows so far, can't fall into the range asked for, or if its labels can't; pairs of leaves are scored exactly. The same
intervals decide which cells an anchor piece meets at all. First each piece searches the cells below its own node, then
those others that still may hold better rows. The positives' scores bound the range of the negatives' search.

Anchor pieces meet candidates in groups of about STRIPE pieces; a group keeps the best rows of its anchors only, whatever
the number of candidates, and groups are merged per anchor piece. The sample changes the pruning, never the result.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
other lengths are filled up with zeros; rows that repeat a vec_id are rows of their own, but none of them is another
row's positive; fewer partners than asked for are all returned; an anchor without positives gives no row; a product
outside of the long range counts as its nearest end; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST_SHARE = 80  # a negative's score in percent of the positive's, at least
EVERY = 100
PIECE, ANCHORS = 4096, 1024
LEAF, ANCHOR_LEAF = 256, 32
SAMPLE_VALUES, CELLS, ROWS_PER_CELL = 1 << 20, 1024, 16
STRIPE = 8
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
LOWEST = -LONG - 1
VECTOR_SCHEMA = "vec_id long, label long, wide boolean, q binary, cell int, salt long, distance double"
PIECE_SCHEMA = "cell int, piece int, wide boolean, ids binary, labels binary, q binary, tree binary"
FOUND_SCHEMA = "acell int, apiece int, scores binary, found binary"
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class CoarseTree:
    """Planes that split space in 2^depth cells, and the cells' centres."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.dim = depth, sample.shape[1]
        self.normals, self.offsets = np.zeros(((1 << depth) - 1, self.dim)), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            below = []
            for i, own in enumerate(parts):
                normal = _far_direction(own)
                along = own @ normal
                offset = float(np.median(along)) if len(own) else 0.0
                self.normals[(1 << level) - 1 + i], self.offsets[(1 << level) - 1 + i] = normal, offset
                below += [own[along <= offset], own[along > offset]]
            parts = below
        self.centres = np.stack([own.mean(0) if len(own) else np.zeros(self.dim) for own in parts])

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (np.einsum("ij,ij->i", x, self.normals[at]) > self.offsets[at])
        return node


def _far_direction(x: np.ndarray) -> np.ndarray:
    """From the point furthest from the mean to the one furthest from that; 0 where all are equal."""
    if not len(x):
        return np.zeros(x.shape[1])
    one = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    return x[np.argmax(((x - one) ** 2).sum(1))] - one


def _grow(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the nodes of their tree: start, end, left and right child (-1 for a leaf)."""
    order = np.lexsort((ids, labels))
    nodes, todo = [[0, len(ids), -1, -1]], [0]
    while todo:
        node = todo.pop()
        start, end = nodes[node][:2]
        if end - start <= leaf:
            continue
        own = order[start:end]
        middle = (end - start) // 2
        if labels[own[0]] != labels[own[-1]]:
            cuts = np.flatnonzero(np.diff(labels[own])) + 1
            middle = int(cuts[np.argmin(np.abs(cuts - middle))])
        else:
            order[start:end] = own[np.argsort(x[own] @ _far_direction(x[own]), kind="stable")]
        for side, (a, b) in enumerate(((start, start + middle), (start + middle, end))):
            nodes[node][2 + side] = len(nodes)
            todo.append(len(nodes))
            nodes.append([a, b, -1, -1])
    return order, np.array(nodes, np.int32)


class Tree:
    """A piece: its rows in the order of its leaves, and what its nodes know."""

    def __init__(self, row, dim: int):
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        self.x = np.frombuffer(row.q, np.float64 if row.wide else np.int16).reshape(len(self.ids), dim).astype(np.float64)
        self.nodes = np.frombuffer(row.tree, np.int32).reshape(-1, 4)
        n = len(self.nodes)
        self.centres, self.radii = np.empty((n, dim)), np.empty(n)
        self.low, self.high, self.least = (np.empty(n, np.int64) for _ in range(3))
        for i, (start, end, *_) in enumerate(self.nodes):
            own = self.x[start:end]
            self.centres[i] = own.mean(0)
            self.radii[i] = math.sqrt(((own - self.centres[i]) ** 2).sum(1).max())
            self.low[i], self.high[i] = self.labels[start:end].min(), self.labels[start:end].max()
            self.least[i] = self.ids[start:end].min()
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.most = float(np.abs(self.x).max(initial=0.0))


def intervals(centres: np.ndarray, radii: np.ndarray, others: np.ndarray, radii2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of points of balls, widened by rounding; exact for balls without extent."""
    norms, norms2 = np.sqrt((centres**2).sum(1)), np.sqrt((others**2).sum(1))
    middle = centres @ others.T
    room = norms[:, None] * radii2 + radii[:, None] * norms2 + radii[:, None] * radii2
    scale = (norms + radii)[:, None] * (norms2 + radii2)
    room = np.where((room > 0) | (scale >= EXACT), room + 1e-9 * scale, 0.0)
    return middle - room, middle + room


class Best:
    """The first rows of each slot (an anchor's, or an anchor's positive's) by score and id. Slots have a range of scores
    that are wanted; a slot without one has an empty range."""

    def __init__(self, anchors: Tree, slots: int, keep: int, same: bool, low: np.ndarray, high: np.ndarray):
        n = len(anchors.ids)
        self.anchors, self.slots, self.keep, self.same = anchors, slots, keep, same
        self.low, self.high = low.reshape(n, slots).copy(), high.reshape(n, slots)
        self.scores, self.ids = np.full((n * slots, keep), LOWEST), np.full((n * slots, keep), LONG)

    def hopeless(self, node: int, lo: float, hi: float, least: int) -> bool:
        start, end = self.anchors.nodes[node][:2]
        low, high = self.low[start:end], self.high[start:end]
        last = self.ids.reshape(-1, self.slots, self.keep)[start:end, :, -1]
        return bool(((low > high) | (hi < low) | (lo > high) | ((hi == low) & (least >= last))).all())

    def add(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(some, self.keep)])
        scores, ids = np.concatenate([scores, self.scores[some].reshape(-1)]), np.concatenate([ids, self.ids[some].reshape(-1)])
        order = np.lexsort((ids, ~scores, slot))
        first = np.searchsorted(slot[order], some)
        at = order[first[:, None] + np.arange(self.keep)]
        self.scores[some], self.ids[some] = scores[at], ids[at]
        full = self.ids[some, -1] != LONG
        flat = self.low.reshape(-1)
        flat[some[full]] = np.maximum(flat[some[full]], self.scores[some[full], -1])

    def score(self, node: int, other: Tree, leaf: int) -> None:
        a, b = slice(*self.anchors.nodes[node][:2]), slice(*other.nodes[leaf][:2])
        x, y = self.anchors.x[a], other.x[b]
        if self.anchors.most * other.most * x.shape[1] < EXACT:
            products = (x @ y.T).astype(np.int64)
        else:  # Python's integers
            exact = np.array([[int(v) for v in r] for r in x], object) @ np.array([[int(v) for v in r] for r in y], object).T
            products = np.clip(exact, LOWEST + 1, LONG).astype(np.int64)
        fits = self.anchors.labels[a][:, None] == other.labels[b]
        fits = fits & (self.anchors.ids[a][:, None] != other.ids[b]) if self.same else ~fits
        for s in range(self.slots):
            i, j = np.nonzero(fits & (products >= self.low[a, s][:, None]) & (products <= self.high[a, s][:, None]))
            if len(i):
                self.add((i + a.start) * self.slots + s, products[i, j], other.ids[b][j])

    def search(self, other: Tree) -> None:
        """All pairs of nodes that aren't hopeless, the most promising ones first."""
        mine, theirs = self.anchors, other
        lo, hi = intervals(mine.centres, mine.radii, theirs.centres, theirs.radii)
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.same and (mine.low[a] > theirs.high[b] or mine.high[a] < theirs.low[b]):
                continue
            if not self.same and mine.low[a] == mine.high[a] == theirs.low[b] == theirs.high[b]:
                continue
            if self.hopeless(a, lo[a, b], hi[a, b], theirs.least[b]):
                continue
            down_a, down_b = mine.nodes[a][2:], theirs.nodes[b][2:]
            if down_a[0] < 0 and down_b[0] < 0:
                self.score(a, theirs, b)
                continue
            pairs = [(x, y) for x in (down_a if down_a[0] >= 0 else [a]) for y in (down_b if down_b[0] >= 0 else [b])]
            todo += sorted(pairs, key=lambda p: (hi[p], -theirs.least[p[1]]))


def _blobs(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _clean(vectors, dim: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors, and their integers as doubles, filled up to dim."""
    places, out = [], []
    for i, v in enumerate(vectors):
        if v is not None:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                places.append(i)
                q = np.clip(np.floor(SCALE * x), -np.finfo(float).max, np.finfo(float).max)
                out.append(q if dim is None or len(q) == dim else np.pad(q, (0, dim - len(q))))
    return np.array(places, np.int64), out


def _vectors(dim: int, tree) -> Callable:
    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0
        for frame in frames:
            places, rows = _clean(frame["vector"], dim)
            if not rows:
                continue
            x = np.stack(rows)
            cell = tree.value.cells(x)
            distance = np.sqrt(((x - tree.value.centres[cell]) ** 2).sum(1))
            wide = np.abs(x).max(1, initial=0.0) > 32767
            q = [r.tobytes() if w else r.astype(np.int16).tobytes() for r, w in zip(x, wide)]
            own = frame.iloc[places]
            yield pd.DataFrame({"vec_id": own["vec_id"].array, "label": own["label"].array, "wide": wide, "q": q, "cell": cell, "salt": made + np.arange(len(x)), "distance": distance})
            made += len(x)

    return vectors


def _packed(leaf: int, dim: int) -> Callable:
    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(q, np.float64 if w else np.int16).astype(np.float64) for q, w in zip(frame["q"], frame["wide"])]).reshape(len(frame), dim)
        ids, labels, wide = frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), bool(frame["wide"].any())
        order, nodes = _grow(ids, labels, x, leaf)
        values = x[order] if wide else x[order].astype(np.int16)
        return pd.DataFrame([(frame["cell"].iloc[0], frame["piece"].iloc[0], wide, *_blobs(ids[order], labels[order], values, nodes))], columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return packed


def _pieces(rows: DataFrame, counts: DataFrame, size: int, leaf: int, dim: int, label: str) -> DataFrame:
    """rows in pieces of about size rows of a cell each; counts has the bounded number of cells with their rows n."""
    each = F.broadcast(counts.select("cell", F.ceil(F.col("n") / size).cast("int").alias("pieces")))
    dealt = rows.join(each, "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id", "salt"), F.col("pieces")).cast("int"))
    return stored(dealt.select("cell", "piece", "vec_id", "label", "wide", "q").groupBy("cell", "piece").applyInPandas(_packed(leaf, dim), PIECE_SCHEMA), label)


def _ranges(n: int, slots: int, row) -> tuple[np.ndarray, np.ndarray]:
    """The scores that each slot wants: all, or a share of the positive's score up to that score."""
    if row.positives is None:
        low, high = np.full(n, LOWEST + 1), np.full(n, LONG)
    else:
        high = np.frombuffer(row.positives, np.int64)
        low = np.where(high >= 0, high // 100 * LEAST_SHARE - (-LEAST_SHARE * (high % 100) // 100), LONG)
    if row.bounds is not None:  # the last kept score of what has been searched
        low = np.maximum(low, np.frombuffer(row.bounds, np.int64).reshape(n * slots, -1)[:, -1])
    return low, high


def _wanted_cells(cells: pd.DataFrame, centres: np.ndarray, dim: int, slots: int, keep: int, same: bool, shift: int, own: bool) -> Callable:
    """For an anchor piece the cells below its own node, or those others that may hold something better."""

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, radii = cells["cell"].to_numpy(), cells["radius"].to_numpy()
        least, low, high = (cells[c].to_numpy() for c in ("least", "low", "high"))
        for frame in frames:
            for row in frame.itertuples():
                inside = ids >> shift == row.acell
                if own:
                    take, order = inside, np.zeros(len(ids))
                else:
                    tree = Tree(row, dim)
                    best = Best(tree, slots, keep, same, *_ranges(len(tree.ids), slots, row))
                    if row.bound_ids is not None:
                        best.ids = np.frombuffer(row.bound_ids, np.int64).reshape(-1, keep)
                    lo, hi = intervals(tree.centres, tree.radii, centres[ids], radii)
                    leaves = np.flatnonzero(tree.nodes[:, 2] < 0)
                    take, order = np.zeros(len(ids), bool), -hi[0]
                    for c in np.flatnonzero(~inside):
                        for a in leaves:
                            fits = tree.low[a] <= high[c] and tree.high[a] >= low[c] if same else not tree.low[a] == tree.high[a] == low[c] == high[c]
                            if fits and not best.hopeless(a, lo[a, c], hi[a, c], least[c]):
                                take[c] = True
                                break
                yield pd.DataFrame({"acell": row.acell, "apiece": row.apiece, "cell": ids[take], "at": order[take]})

    return wanted


def _searched(dim: int, slots: int, keep: int, same: bool) -> Callable:
    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, the group's anchors before its candidates."""
        key, best = None, None

        def result() -> pd.DataFrame:
            return pd.DataFrame([(*key[:2], *_blobs(best.scores, best.ids))], columns=["acell", "apiece", "scores", "found"])

        for frame in frames:
            for row in frame.itertuples():
                if (row.acell, row.apiece, row.stripe) != key:
                    if best is not None:
                        yield result()
                    key, anchors = (row.acell, row.apiece, row.stripe), Tree(row, dim)
                    best = Best(anchors, slots, keep, same, *_ranges(len(anchors.ids), slots, row))
                else:
                    best.search(Tree(row, dim))
        if best is not None:
            yield result()

    return searched


def _merged(keep: int) -> Callable:
    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        scores = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, keep) for b in frame["scores"]], 1)
        ids = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, keep) for b in frame["found"]], 1)
        order = np.lexsort((ids, ~scores), axis=1)[:, :keep]
        return pd.DataFrame([(frame["acell"].iloc[0], frame["apiece"].iloc[0], *_blobs(np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)))], columns=["acell", "apiece", "scores", "found"])

    return merged


class Search:
    """Anchor pieces against candidate pieces."""

    def __init__(self, anchors: DataFrame, candidates: DataFrame, cells: pd.DataFrame, tree: CoarseTree, shift: int):
        self.anchors, self.candidates, self.cells, self.tree, self.shift = anchors, candidates, cells, tree, shift
        stripes = max(1, -(-candidates.count() // STRIPE))
        self.places = candidates.select("cell", "piece", F.pmod(F.xxhash64("cell", "piece"), F.lit(stripes)).cast("int").alias("stripe"))

    def _phase(self, anchors: DataFrame, slots: int, keep: int, same: bool, own: bool) -> DataFrame:
        dim, centres = self.tree.dim, self.tree.centres
        wanted = anchors.mapInPandas(_wanted_cells(self.cells, centres, dim, slots, keep, same, self.shift, own), "acell int, apiece int, cell int, at double")
        pairs = stored(wanted.join(self.places, "cell"), "mine-pairs")
        columns = ["acell", "apiece", "stripe", "at", "wide", "ids", "labels", "q", "tree"]
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("positives", "bounds")]
        theirs = self.candidates.join(pairs, ["cell", "piece"]).select(*columns, *nothing)
        groups = pairs.select("acell", "apiece", "stripe", F.lit(float("-inf")).alias("at")).distinct()
        mine = anchors.join(groups, ["acell", "apiece"]).select(*columns, "positives", "bounds")
        both = mine.unionByName(theirs).repartition("acell", "apiece", "stripe").sortWithinPartitions("acell", "apiece", "stripe", "at")
        found = both.mapInPandas(_searched(dim, slots, keep, same), FOUND_SCHEMA)
        return stored(found.groupBy("acell", "apiece").applyInPandas(_merged(keep), FOUND_SCHEMA), "mine-found")

    def best(self, slots: int, keep: int, same: bool, positives: DataFrame | None) -> DataFrame:
        """acell, apiece, scores, found: per anchor and slot the first rows, best first."""
        none = F.lit(None).cast("binary")
        anchors = self.anchors.withColumn("positives", none) if positives is None else self.anchors.join(positives.select("acell", "apiece", F.col("scores").alias("positives")), ["acell", "apiece"])
        first = self._phase(anchors.withColumns({"bounds": none, "bound_ids": none}), slots, keep, same, True)
        if len(np.unique(self.cells["cell"].to_numpy() >> self.shift)) < 2:
            return first
        bounded = anchors.join(first.select("acell", "apiece", F.col("scores").alias("bounds"), F.col("found").alias("bound_ids")), ["acell", "apiece"])
        second = self._phase(bounded, slots, keep, same, False)
        return stored(first.unionByName(second).groupBy("acell", "apiece").applyInPandas(_merged(keep), FOUND_SCHEMA), "mine-best")


def _triples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            ids = np.frombuffer(row.ids, np.int64)
            score, positive = (np.frombuffer(b, np.int64).reshape(len(ids), POSITIVES) for b in (row.positive_scores, row.positive_ids))
            negative_score, negative = (np.frombuffer(b, np.int64).reshape(len(ids), POSITIVES, NEGATIVES) for b in (row.scores, row.found))
            i, p, k = np.nonzero((negative_score != LOWEST) & (score != LOWEST)[:, :, None])
            yield pd.DataFrame({"anchor_id": ids[i], "positive_id": positive[i, p], "rank": k + 1, "negative_id": negative[i, p, k], "positive_score": score[i, p], "negative_score": negative_score[i, p, k]})


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows vec_id, label, vector."""
    spark = rows.sparkSession
    text_batches(spark)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")).dropna()
    n, dim = own.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], RESULT_SCHEMA)
    most = max(SAMPLE_VALUES // max(dim, 1), 64 * ROWS_PER_CELL)
    depth = max(0, min(math.ceil(math.log2(n / PIECE)), int(math.log2(CELLS)), int(math.log2(min(n, most) / ROWS_PER_CELL))))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // most))) == 0
    sample = [r["vector"] for r in own.filter(share).select("vector").limit(most).collect()] if depth else []
    sample = _clean(sample, dim)[1]
    coarse = CoarseTree(np.stack(sample) if sample else np.zeros((0, dim)), depth if sample else 0)
    vectors = stored(own.mapInPandas(_vectors(dim, spark.sparkContext.broadcast(coarse)), VECTOR_SCHEMA), "mine-vectors")
    cells = stored(vectors.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("vec_id").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")), "mine-cells")
    candidates = _pieces(vectors, cells, PIECE, LEAF, dim, "mine-candidates")
    anchors = vectors.filter(F.col("vec_id") % EVERY == 0 if is_anchor is None else is_anchor)
    shift = max(0, coarse.depth - max(0, math.ceil(math.log2(max(anchors.count(), 1) / ANCHORS))))
    anchors = anchors.withColumn("cell", F.shiftright("cell", shift))
    groups = stored(anchors.groupBy("cell").agg(F.count("*").alias("n")), "mine-groups")
    packed = _pieces(anchors, groups, ANCHORS, ANCHOR_LEAF, dim, "mine-anchors").withColumnsRenamed({"cell": "acell", "piece": "apiece"})
    search = Search(packed, candidates, cells.toPandas(), coarse, shift)
    positives = search.best(1, POSITIVES, True, None)
    negatives = search.best(POSITIVES, NEGATIVES, False, positives)
    known = packed.select("acell", "apiece", "ids").join(positives.select("acell", "apiece", F.col("scores").alias("positive_scores"), F.col("found").alias("positive_ids")), ["acell", "apiece"])
    return stored(known.join(negatives, ["acell", "apiece"]).mapInPandas(_triples, RESULT_SCHEMA), "mine-triples")

"""Best files of many prompts by the share of a prompt's words that a file has, plus a base score, counted in bit planes.

Files are packed in parts of one group and prompts in blocks of one group, both of bounded size. In a part a word is a row of bits, one
for each file, best base first. The rows of a prompt's words are added bit by bit in planes, for 64 files at once, in counters
that start so that they overflow where a file can be among the first k; only such files are looked at. A block's task takes the
parts of its group one after another, so that k rows a prompt leave it, however many parts there are.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources.store import kept
from .cells import NEAR

#: Characters of a part's files, about; asked words of a block, about, where there are enough for all cores and at most.
PART, LEAST_BLOCK, MOST_BLOCK = 30_000_000, 20_000, 1_000_000
#: Words of more than one in so many files of a part have a row of bits; of the others files are listed.
DENSE = 512
#: 64-bit words that one step of the counters covers, for as many prompts as fit.
STEP = 16384
#: A range of a part's files is so much longer than all before it, whose scores prune it.
WIDER = 16
#: Rows that are merged at once, about.
MERGED = 1_000_000
#: Bytes of text that are cut in words at once, about.
TEXT = 4_000_000
#: Tasks that meet blocks at most.
MOST_TASKS = 10_000


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    return np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]) if len(keys[0]) else np.empty(0, dtype="int64")


def _ranks(starts: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows in their runs."""
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def _ranges(lo: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each of lo, as many as lengths says."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + lengths, lengths)


def _lean() -> None:
    """For Python workers, which stay for later tasks: large arrays go back to the system when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not the GNU library
        return
    for option, value in ((-3, 1 << 20), (-1, 1 << 20)):  # least size of a mapping of its own; free bytes at the heap's end
        mallopt(option, value)


def _packed(**columns) -> bytes:
    """Arrays of any lengths as bytes, which the JVM hands over as they are."""
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
    table, out = pa.table({c: lists(x) for c, x in columns.items()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(value: pa.BinaryScalar) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {c: row.column(c)[0].values for c in row.schema.names}


def _coded(words: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words once, and the place of each word among these."""
    words = words.dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return words.dictionary, words.indices.to_numpy()


_IN_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", dtype="uint8"))


def _words(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """How many words of more than three characters each text has, and these words, as `text.keywords` finds them: longest runs
    of ASCII word characters. A word may be there more than once."""
    cuts = np.frombuffer(texts.buffers()[1], dtype="int32", count=len(texts) + 1, offset=texts.offset * 4).astype("int64")
    data = np.frombuffer(texts.buffers()[2] or b"", dtype="uint8")[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    inside = np.r_[False, _IN_WORD[data], False]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    first[edges], last[edges - 1] = inside[edges + 1], inside[edges]
    lo, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lo, n = lo[ends - lo > 3], (ends - lo)[ends - lo > 3]
    words = pa.StringArray.from_buffers(len(lo), pa.py_buffer(np.r_[0, np.cumsum(n)].astype("int32")), pa.py_buffer(data[_ranges(lo, n)]))
    return np.diff(np.searchsorted(lo, cuts)), words


def _part(key: tuple, table: pa.Table) -> pa.Table:
    """Postings of a part by word, as places in its list of files, best base first."""
    _lean()
    doc, base = (table.column(c).to_numpy() for c in ("doc_id", "base"))
    order = np.lexsort((doc, -base))
    place = np.empty(len(doc), dtype="int64")
    place[order] = np.arange(len(doc))
    found, counts = [], []
    for texts in table.column("text").cast(pa.string()).chunks:
        at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64") // TEXT
        cuts = np.r_[_starts(at), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            n, own = _words(texts.slice(a, b - a))
            found.append(own)
            counts.append(n)
    words, coded = _coded(pa.chunked_array(found, pa.string()))
    ends, lo = np.cumsum([len(x) for x in found]), 0
    found.clear()
    # a file's words are in one piece, so those that it has more than once are dropped piece by piece
    met = []
    for n, a, b in zip(counts, np.r_[0, ends], ends):
        own = np.sort(coded[a:b].astype("int64") * len(doc) + np.repeat(place[lo : lo + len(n)], n))
        met.append(own[_starts(own)])
        lo += len(n)
    del coded, counts
    met = np.concatenate(met)
    met.sort()
    word, places = (met // len(doc)).astype("int32"), (met % len(doc)).astype("int32")
    del met
    counts = np.bincount(word, minlength=len(words)).astype("int32")
    # stop words are no keywords
    stop = pc.is_in(words, value_set=pa.array(V.KEYWORD_STOP)).to_numpy(zero_copy_only=False)
    places, words, counts = places[~stop[word]], words.filter(pa.array(~stop)), counts[~stop]
    data = _packed(words=words, counts=counts, places=places.astype("uint16" if len(doc) <= 1 << 16 else "int32"), docs=doc[order], bases=base[order])
    return pa.table({"group": pa.array([key[0].as_py()], key[0].type), "part": pa.array([data], pa.binary())})


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Asked words of a block, query by query."""
    lists = table.column("words").cast(pa.list_(pa.string()))
    words, word = _coded(pa.chunked_array([x.flatten() for x in lists.chunks], pa.string()))
    data = _packed(queries=table.column("query_id").to_numpy(), asked=words, m=pc.list_value_length(lists).to_numpy().astype("int64"), term=word.astype("int32"))
    return pa.table({"asks": pa.array([key[0].as_py()], key[0].type), "number": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([data], pa.binary())})


class _Block:
    """The queries of a block and the best rows of each so far."""

    def __init__(self, row: dict, k: int, scale: float):
        self.queries, self.words, self.m, self.term, self.k, self.scale = row["queries"].to_numpy(), row["asked"], row["m"].to_numpy(), row["term"].to_numpy().astype("int64"), k, scale
        self.query = np.repeat(np.arange(len(self.m)), self.m)
        self.bound = np.full(len(self.m), -np.inf)
        self.best = [np.empty(0, dtype=t) for t in ("int64", "int64", "int64", "float64", "float64", "int64", "object")]

    def add(self, rows: list) -> None:
        """Merges rows (query, doc, n, base, score, place, shared); of those of a query that are left some may be beyond k, by rounding."""
        touched = np.zeros(len(self.m), dtype=bool)
        touched[rows[0]] = True
        old = touched[self.best[0]]
        rows = [np.concatenate([x[old], y]) for x, y in zip(self.best, rows)]
        order = np.lexsort((rows[1], -rows[4], rows[0]))
        rows = [x[order] for x in rows]
        q, score = rows[0], rows[4]
        starts = _starts(q)
        full = np.diff(np.r_[starts, len(q)]) >= self.k
        self.bound[q[starts[full]]] = score[starts[full] + self.k - 1]
        left = (score >= self.bound[q] - NEAR) & (_ranks(_starts(q, score), len(q)) < self.k)
        self.best = [np.concatenate([x[~old], y[left]]) for x, y in zip(self.best, rows)]

    def meet(self, part: dict, first: int) -> None:
        """One cell: the files of a part, in ranges that widen, the best by base first."""
        cell, lo, hi = _Cell(self, part), 0, max(-(-first // 64), 1)
        while lo < cell.width:
            cell.meet(lo, min(hi, cell.width))
            lo, hi = hi, hi * WIDER
        q, place, shared = self.best[0], *self.best[5:]
        new = np.flatnonzero(place >= 0)
        if len(new):
            shared[new] = cell.shared(q[new], place[new])
            place[new] = -1


class _Cell:
    def __init__(self, block: _Block, part: dict):
        self.block = block
        self.docs, self.bases, counts = (part[c].to_numpy() for c in ("docs", "bases", "counts"))
        self.places = part["places"].to_numpy().astype("int32")
        self.width = -(-len(self.docs) // 64)
        at = pc.fill_null(pc.index_in(block.words, value_set=part["words"]), -1).to_numpy().astype("int64")
        self.counts, self.at, ends = counts, at, np.cumsum(counts, dtype="int64")
        count = np.where(at >= 0, counts[at], 0).astype("int64")
        dense = count > len(self.docs) // DENSE
        rows = self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.bits = np.zeros((int(dense.sum()) + 1, self.width), dtype="uint64")
        self._fill(ends[at[dense]] - count[dense], count[dense])
        # entries of queries: those with a row of bits, and those with a list
        row, listed = rows[block.term], (count > 0)[block.term] & ~dense[block.term]
        own = row >= 0
        self.rows, self.row_cuts = row[own], np.r_[0, np.cumsum(np.bincount(block.query[own], minlength=len(block.m)))]
        self.lists, self.list_cuts = block.term[listed], np.r_[0, np.cumsum(np.bincount(block.query[listed], minlength=len(block.m)))]
        self.list_lo, self.list_n = ends[at] - count, count
        # queries with as many rows stand together; those that share no word are left out
        n = np.diff(self.row_cuts)
        order = np.argsort(n, kind="stable")
        self.order = order[(n + np.diff(self.list_cuts))[order] > 0]

    def _fill(self, lo: np.ndarray, counts: np.ndarray) -> None:
        flat = self.bits.reshape(-1)
        for a in range(0, len(lo), 1024):
            own = counts[a : a + 1024]
            places = self.places[_ranges(lo[a : a + 1024], own)]
            words = np.repeat(np.arange(a, a + len(own)) * self.width, own) + (places >> 6)
            starts = _starts(words)
            flat[words[starts]] = np.add.reduceat(np.uint64(1) << (places & 63).astype("uint64"), starts)

    def meet(self, lo: int, hi: int) -> None:
        block, found, n = self.block, [], 0
        tops = self.bases[np.arange(lo, hi) * 64]
        # a word of files is left out where not even one with all of a query's words can be among the best
        reach = np.searchsorted(-tops, block.scale - block.bound + 2 * NEAR, side="right")
        order = self.order[reach[self.order] > 0]
        size = max(STEP // (hi - lo), 1)
        for a in range(0, len(order), size):
            q = order[a : a + size]
            rows = self._candidates(q, lo, tops[: reach[q].max()])
            if rows:
                found.append(rows)
                n += len(rows[0])
            if found and (n > MERGED or a + size >= len(order)):
                block.add([np.concatenate(x) for x in zip(*found)])
                found, n = [], 0

    def shared(self, q: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The words that each query shares with a file, in the order in which it asks for them."""
        block, n = self.block, len(self.docs)
        own = block.m[q]
        words, place = block.term[_ranges((np.cumsum(block.m) - block.m)[q], own)], np.repeat(place, own)
        row = self.row[words]
        here = (row >= 0) & (self.bits[row, place >> 6] >> (place & 63).astype("uint64") & np.uint64(1)).astype("bool")
        rest = np.flatnonzero((row < 0) & (self.list_n[words] > 0))
        if len(rest):
            there = np.repeat(np.arange(len(self.counts)) * n, self.counts) + self.places
            asked = self.at[words[rest]] * n + place[rest]
            here[rest] = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
        out = np.empty(len(q), dtype="object")
        out[:] = [words[a:b][here[a:b]] for a, b in zip(np.cumsum(own) - own, np.cumsum(own))]
        return out

    def _listed(self, q: np.ndarray, lo: int, width: int) -> list:
        """Rows of bits for the listed words of queries; the i-th row has the files of which i words before are listed too."""
        own = np.diff(self.list_cuts)[q]
        terms = self.lists[_ranges(self.list_cuts[q], own)]
        counts = self.list_n[terms]
        at = np.repeat(np.repeat(np.arange(len(q)), own), counts)
        places = self.places[_ranges(self.list_lo[terms], counts)].astype("int64") - lo * 64
        here = (places >= 0) & (places < width * 64)
        key = np.sort(at[here] * (width * 64) + places[here])
        rank, out = _ranks(_starts(key), len(key)), []
        while len(key):
            first, bits = rank == len(out), np.zeros(len(q) * width, dtype="uint64")
            own = key[first]
            if not len(own):
                break
            starts = _starts(own >> 6)
            bits[own[starts] >> 6] = np.add.reduceat(np.uint64(1) << (own & 63).astype("uint64"), starts)
            out.append(bits.reshape(len(q), width))
        return out

    def _candidates(self, q: np.ndarray, lo: int, tops: np.ndarray) -> list | None:
        """Rows (query, doc, n, base, score, place, shared) of the files below 64-bit words from lo that reach their query's bound."""
        block, width = self.block, len(tops)
        m, bound = block.m[q][:, None], block.bound[q][:, None]
        need = np.ceil((bound - NEAR) * m / block.scale - 1e-6 - tops * (m / block.scale))
        need = np.clip(need, 1, m + 1, out=need).astype("int64")
        depth = int(m.max() + 1).bit_length()
        start = np.uint64(1 << depth) - np.arange(int(m.max()) + 2, dtype="uint64")
        planes = [np.take(np.uint64(0) - (start >> np.uint64(i) & np.uint64(1)), need) for i in range(depth)]
        over, waiting, t = np.zeros_like(planes[0]), [None] * depth, np.empty_like(planes[0])

        def put(x: np.ndarray, i: int, alone: bool = False) -> None:
            while i < depth:
                p, y = planes[i], waiting[i]
                if y is None and not alone:
                    waiting[i] = x
                    return
                if y is None:
                    np.bitwise_and(p, x, out=t)
                    np.bitwise_xor(p, x, out=p)
                    x[...] = t
                else:
                    # a full adder: three bits of a plane become one of it and one of the next
                    waiting[i] = None
                    np.bitwise_xor(x, y, out=t)
                    np.bitwise_and(x, y, out=x)
                    np.bitwise_and(t, p, out=y)
                    np.bitwise_xor(p, t, out=p)
                    np.bitwise_or(x, y, out=x)
                i += 1
                alone = False
            np.bitwise_or(over, x, out=over)

        n = np.diff(self.row_cuts)[q]
        rows = np.full((int(n.max()), len(q)), len(self.bits) - 1)
        rows[_ranges(np.zeros(len(q), dtype="int64"), n), np.repeat(np.arange(len(q)), n)] = self.rows[_ranges(self.row_cuts[q], n)]
        bits = self.bits[:, lo : lo + width]
        for r in rows:
            put(bits[r], 0)
        for x in self._listed(q, lo, width):
            put(x, 0)
        for i in range(depth):
            if waiting[i] is not None:
                x, waiting[i] = waiting[i], None
                put(x, i, True)

        word = np.flatnonzero(over)
        if not len(word):
            return None
        i, bit = np.nonzero(np.unpackbits(over.reshape(-1)[word].astype("<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little"))
        word, bit = word[i], bit.astype("uint64")
        n = need.reshape(-1)[word]
        for i, p in enumerate(planes):
            n += ((p.reshape(-1)[word] >> bit & np.uint64(1)) << np.uint64(i)).astype("int64")
        at = q[word // width]
        place = (lo + word % width) * 64 + bit.astype("int64")
        score = n / block.m[at] * block.scale + self.bases[place]
        here = score >= block.bound[at] - NEAR
        place = place[here]
        return [at[here], self.docs[place], n[here], self.bases[place], score[here], place, np.full(len(place), None)] if len(place) else None


def _cells(k: int, scale: float, first: int):
    def run(batches):
        _lean()
        blocks = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key = row["number"].as_py()
                if key not in blocks:
                    blocks[key] = (row["group"], _Block(_unpacked(row["block"]), k, scale))
                blocks[key][1].meet(_unpacked(row["part"]), first)
        for group, x in blocks.values():
            q, doc, n, base, _, _, shared = x.best
            words = x.words.take(pa.array(np.concatenate([np.empty(0, dtype="int64"), *shared])))
            shared = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), words), ",")
            own = {"group": pa.array([group.as_py()] * len(q), group.type), "query_id": x.queries[q], "m": x.m[q], "doc_id": doc, "n": n, "base": base, "shared": shared}
            yield from pa.table(own).to_batches(10_000)

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, most: int, by: str, into: str) -> DataFrame:
    """rows with the number of the share that they go to, of one group and about most units. sizes: group, size."""
    shares = sizes.select("group", F.greatest(F.ceil(F.col("size") / most).cast("long"), F.lit(1)).alias("shares"))
    before = F.coalesce(F.sum("shares").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(shares.withColumn("before", before), "group").withColumn(into, F.col("before") + F.pmod(F.xxhash64(by), "shares")).drop("shares", "before")


def best(asked: DataFrame, files: DataFrame, sizes: DataFrame, k: int, scale: float, first: int) -> DataFrame:
    """group, query_id, m, doc_id, n, base, shared: how many of its m words a query shares with a file of its group, and which, for files
    among which are the first k of every query by n / m * scale + base and id, of those that share a word. asked: query_id, group,
    words, a word once; files: group, doc_id, base, text, in lower case, of which words are cut as in `text.keywords`; sizes: group, size,
    the characters of its files, by which they are dealt to parts. Ids are whole numbers. first: files of a part that are scored
    before all others. files are read once."""
    kind = dict(files.dtypes)["group"]
    asked = asked.filter(F.size("words") > 0)
    sizes = kept(sizes, "file-sizes")
    asks = kept(asked.groupBy("group").agg(F.sum(F.size("words")).alias("size")).join(sizes, "group", "left_semi"), "asked-sizes")
    sizes = sizes.join(asks, "group", "left_semi")
    parts = _dealt(files.filter("text <> ''"), sizes, PART, "doc_id", "part").groupBy("group", "part")
    parts = kept(parts.applyInArrow(_part, f"group {kind}, part binary"), "file-parts")

    # two blocks for each core, unless they would be very short or long
    total = asks.agg(F.sum("size")).first()[0] or 0
    most = min(max(total // (2 * files.sparkSession.sparkContext.defaultParallelism), LEAST_BLOCK), MOST_BLOCK)
    blocks = _dealt(asked, asks, most, "query_id", "number").groupBy("group", "number")
    blocks = kept(blocks.applyInArrow(_block, f"asks {kind}, number long, block binary"), "asked-blocks")
    n = min(max(blocks.count(), 1), MOST_TASKS)
    # a task for each block, which reads the parts of its group from the shared folder one after another
    blocks = blocks.repartitionById(n, F.pmod("number", F.lit(n)).cast("int"))
    cells = parts.coalesce(1).hint("shuffle_replicate_nl").join(blocks, F.col("group") == F.col("asks"))
    return cells.mapInArrow(_cells(k, scale, first), f"group {kind}, query_id long, m long, doc_id long, n long, base double, shared string")

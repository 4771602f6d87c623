"""Sets of positions as compact byte codes, and the exact join of records that share a cell.

A code is one ``uint16`` count for each 256 positions, then the low byte of every position in order: about a byte an
element, equal for equal sets. Records that share a cell are compared block by block: first by word-parallel folds of
their bit vectors, then exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, release, shuffle_width

FOLD_WORDS = 4  # words of a fold that travels: 256 bits rule out nearly all pairs that a cosine of 0.6 would
BROADCAST_ROWS = 1_000_000  # ids or pairs that may be sent to all executors; more are joined by shuffles
PAIRS = "a bigint, b bigint, o int, na int, nb int"


def encode(lists: pa.ListArray, universe: int) -> tuple[np.ndarray, pa.BinaryArray]:
    """Index of each row with a non-empty set, and its code. Repeated positions count once, order doesn't matter, null
    positions are dropped; a position outside ``0..universe-1`` is an error."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    values = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), sizes)
    if values.null_count:
        rows, values = rows[np.asarray(values.is_valid())], values.drop_null()
    values = np.asarray(values).astype(np.int64)
    if len(values) and (values.min() < 0 or values.max() >= universe):
        raise ValueError(f"a position lies outside 0..{universe - 1}")
    flat = rows * universe + values
    if not (np.diff(flat) > 0).all():
        flat = np.sort(flat, kind="stable")
        flat = flat[np.concatenate([[True], np.diff(flat) > 0])]
        rows, values = flat // universe, flat % universe
    counts = np.bincount(rows, minlength=len(lists))
    kept = np.flatnonzero(counts)
    n = counts[kept]
    blocks = -(-universe // 256)
    slot = np.repeat(np.arange(len(kept)), n)
    heads = np.bincount(slot * blocks + (values >> 8), minlength=len(kept) * blocks).astype("<u2")
    offsets = np.concatenate([[0], np.cumsum(2 * blocks + n)]).astype(np.int32)
    out, body = np.empty(int(offsets[-1]), np.uint8), np.ones(int(offsets[-1]), bool)
    at = (offsets[:-1, None] + np.arange(2 * blocks)).ravel()
    body[at] = False
    out[at], out[body] = heads.view(np.uint8), (values & 255).astype(np.uint8)
    return kept, pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decode(codes: pa.BinaryArray, universe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position) of every element, and the size of every set."""
    blocks = -(-universe // 256)
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = offsets[:-1, None] + np.arange(2 * blocks)
    heads = np.ascontiguousarray(data[at]).view("<u2").astype(np.int64)
    body = np.ones(len(data), bool)
    body[at.ravel()] = False
    n = heads.sum(1)
    return np.repeat(np.arange(len(codes)), n), data[body].astype(np.int64) + 256 * np.repeat(np.tile(np.arange(blocks), len(codes)), heads.ravel()), n


def bit_words(codes: pa.BinaryArray, universe: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit vectors as rows of ``uint64`` words, and the sizes of the sets."""
    width = -(-universe // 64) * 64
    words = np.empty((len(codes), width // 64), np.uint64)
    sizes = np.empty(len(codes), np.int64)
    for lo in range(0, len(codes), 8192):  # bounds the unpacked bits
        part = codes.slice(lo, 8192)
        rows, pos, n = decode(part, universe)
        bits = np.zeros((len(part), width), bool)
        bits[rows, pos] = True
        words[lo : lo + len(part)], sizes[lo : lo + len(part)] = np.packbits(bits, axis=1).view(np.uint64), n
    return words, sizes


def folded(words: np.ndarray, n_words: int) -> np.ndarray:
    """Bit vectors folded to ``n_words`` words by exclusive or; two folds never differ in more bits than the vectors do."""
    pad = -words.shape[1] % n_words
    wide = np.pad(words, ((0, 0), (0, pad)))
    return np.bitwise_xor.reduce(wide.reshape(len(words), -1, n_words), axis=1)


def whole_column(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    joined = pa.chunked_array([b.column(name) for b in batches]).combine_chunks()
    return joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined


def encoded_sets(records: DataFrame, key: str, column: str, universe: int) -> DataFrame:
    """(``row``, ``code``) of every row whose set isn't null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, codes = encode(b.column(1), universe)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), codes], ["row", "code"])

    return records.select(F.col(key).cast("bigint").alias("row"), F.col(column).cast("array<int>").alias("x")).where("row is not null and size(x) > 0").mapInArrow(run, "row bigint, code binary")


def distinct_sets(encoded: DataFrame) -> DataFrame:
    """One row for each distinct set: its ``code``, its smallest row as ``rep``, and how many ``rows`` have it."""
    return encoded.groupBy("code").agg(F.min("row").alias("rep"), F.count("*").alias("rows"))


class Rule:
    """Which pairs count: ``jaccard`` or ``cosine`` of at least a threshold, exactly."""

    def __init__(self, kind: str, threshold: float):
        if kind not in ("jaccard", "cosine") or not 0 < threshold <= 1:
            raise ValueError("kind is jaccard or cosine, the threshold in (0, 1]")
        self.kind, self.threshold = kind, threshold

    def most_apart(self, na: np.ndarray, nb: int) -> np.ndarray:
        """Most elements in which two sets of these sizes may differ."""
        if self.kind == "jaccard":
            return (na + nb) * (1 - self.threshold) / (1 + self.threshold)
        return na + nb - 2 * self.threshold * np.sqrt(na * nb)

    def holds(self, o: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        if self.kind == "jaccard":
            return o >= self.threshold * (na + nb - o) - 1e-9
        return np.round(o / np.sqrt(na * nb), 6) >= self.threshold

    def widest(self, n: np.ndarray) -> np.ndarray:
        """Largest size that a partner of a set of size ``n`` may have."""
        return np.floor(n / (self.threshold if self.kind == "jaccard" else self.threshold**2) + self.slack(n))

    def narrowest(self, n: np.ndarray) -> np.ndarray:
        """Smallest size that a partner of a set of size ``n`` may have."""
        return np.ceil(n * (self.threshold if self.kind == "jaccard" else self.threshold**2) - self.slack(n))

    def slack(self, n: np.ndarray) -> np.ndarray:
        """What rounding adds to a size: a cosine counts from six decimals on."""
        return 1e-9 + (n * 2e-6 / self.threshold**3 if self.kind == "cosine" else 0)


def fold_limit(apart: float, width: int, sigmas: float | None) -> float:
    """Bits in which two folds of ``width`` bits may differ if the sets differ in ``apart`` elements.

    ``None``: never more than ``apart`` (nothing is lost). Else the expected number and ``sigmas`` deviations, where that is less.
    """
    if sigmas is None:
        return apart
    p = (1 - np.exp(-2 * apart / width)) / 2
    return min(apart, width * p + sigmas * np.sqrt(width * p * (1 - p)))


def near_pairs(first: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, rule: Rule, sigmas: float | None, rows: int = 256, columns: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i from ``left``, j from ``right``, None: within ``left``, each once) whose folds ``first`` are near enough for the rule.

    Both sides are ordered by size and compared in tiles that fit the processor's cache, each row with the limit that its size and those of the tile's columns give.
    """
    within = right is None
    if not len(left) or right is not None and not len(right):
        return
    left = left[np.argsort(sizes[left], kind="stable")]
    right = left if within else right[np.argsort(sizes[right], kind="stable")]
    n_left, n_right = sizes[left].astype(float), sizes[right].astype(float)
    large = len(left) * len(right) >= 1 << 18  # products need preparation, which few pairs don't pay for
    distances = large and float(max(rule.most_apart(p, q) for p in (n_left[0], n_left[-1]) for q in (n_right[0], n_right[-1]))) < 128 and _by_products(first, left, right, 3 * rows, 2 * columns) or _by_counts(first, left, right, rows, columns)
    for lo in range(0, len(left), distances.rows):
        hi = min(lo + distances.rows, len(left))
        distances.take(lo, hi)
        start = lo if within else int(np.searchsorted(n_right, rule.narrowest(n_left[lo : lo + 1])[0]))
        end = int(np.searchsorted(n_right, rule.widest(n_left[hi - 1 : hi])[0], "right"))
        for c in range(start, end, distances.columns):
            d = min(c + distances.columns, end)
            if isinstance(distances, _by_products):
                far = np.maximum(*(rule.most_apart(n_left[lo:hi], q) for q in (n_right[c], n_right[d - 1])))
            else:
                far = np.array([max(float(rule.most_apart(p, q)) for p in (n_left[lo], n_left[hi - 1]) for q in (n_right[c], n_right[d - 1]))])
            if sigmas is not None:
                far = np.array([fold_limit(x, 64 * first.shape[1], sigmas) for x in far])
            i, j = distances.within(c, d, np.minimum(255, far + 1e-9).astype(np.int64))
            i, j = i + lo, j + c
            if within:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield left[i], right[j]


class _by_counts:
    """Distances of folds as counted bits of their exclusive or."""

    def __init__(self, first: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int, columns: int):
        self.first, self.left, self.rows, self.columns, self.words = first, left, rows, columns, first.shape[1]
        self.columns_of = [np.ascontiguousarray(first[right, k]) for k in range(self.words)]
        self.xor, self.bits, self.gaps = np.empty((rows, columns), np.uint64), np.empty((rows, columns), np.uint8), np.empty((rows, columns), np.uint8)

    def take(self, lo: int, hi: int) -> None:
        self.n, self.rows_of = hi - lo, [self.first[self.left[lo:hi], k][:, None] for k in range(self.words)]

    def within(self, c: int, d: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y, g = (a[: self.n, : d - c] for a in (self.xor, self.bits, self.gaps))
        for k in range(self.words):
            np.bitwise_xor(self.rows_of[k], self.columns_of[k][None, c:d], out=x)
            if k:
                np.bitwise_count(x, out=y)
                np.add(g, y, out=g)  # a sum of 256 wraps to 0 and is then only compared for nothing
            else:
                np.bitwise_count(x, out=g)
        return np.divmod(np.flatnonzero(g <= most.max()), d - c)


class _by_products:
    """Distances of folds by a product of their bits in single precision, three rows in one: each takes eight of the 24 bits that a float holds exactly.

    A row's value is 127 plus the bits in common and half of its limit, less half of the bits of either side (all rounded down): at least 127 for all that is
    near, and little else, which is counted. False where folds have so many bits that a value or a sum on the way to it could leave its eight bits.
    """

    def __init__(self, first: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int, columns: int):
        self.first, self.left, self.right, self.rows, self.columns = first, left, right, rows, columns
        ones = np.bitwise_count(first).sum(1, dtype=np.int64)
        p, q = int(ones[left].max(initial=0)), int(ones[right].max(initial=0))
        self.fits = min(p, q) < 128 and p // 2 + q // 2 < 128
        if self.fits:
            self.half = ones // 2
            self.theirs = self._bits(right)
            self.theirs[:, -2], self.theirs[:, -1] = -self.half[right], 1
            n = min(rows // 3, -(-len(left) // 3)) * min(columns, len(right))  # new arrays for each tile would cost more than the products
            self.product, self.whole, self.flags = np.empty(n, np.float32), np.empty(n, "<i4"), np.empty(4 * n, bool)

    def __bool__(self) -> bool:
        return self.fits

    def _bits(self, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), 64 * self.first.shape[1] + 2), np.float32)
        out[:, :-2] = np.unpackbits(self.first[at].view(np.uint8), axis=1)
        return out

    def take(self, lo: int, hi: int) -> None:
        self.mine, self.n, self.third = self.left[lo:hi], hi - lo, -(-(hi - lo) // 3)
        bits = np.zeros((3 * self.third, self.theirs.shape[1]), np.float32)
        bits[: self.n] = self._bits(self.mine)
        bits[: self.n, -2], bits[: self.n, -1] = 1, 127 - self.half[self.mine]
        self.lanes, self.given = self._in_one(bits), bits[:, -1]

    def _in_one(self, rows: np.ndarray) -> np.ndarray:
        one, two, three = np.split(rows, 3)
        return one + 256 * two + 65536 * three

    def within(self, c: int, d: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = self.given.copy()
        given[: self.n] += most // 2
        self.lanes[:, -1] = self._in_one(given)
        n = self.third * (d - c)
        np.matmul(self.lanes, self.theirs[c:d].T, out=self.product[:n].reshape(self.third, d - c))
        np.copyto(self.whole[:n], self.product[:n], casting="unsafe")
        np.greater_equal(self.whole[:n].view(np.uint8), 127, out=self.flags[: 4 * n])
        row, at = np.divmod(np.flatnonzero(self.flags[: 4 * n]), 4 * (d - c))
        i, j = row + self.third * (at & 3), at >> 2
        near = np.bitwise_count(self.first[self.mine[i]] ^ self.first[self.right[c + j]]).sum(1) <= most[i]
        return i[near], j[near]


ENTRY = np.dtype([("rep", "<i8"), ("size", "<u2"), ("fold", "<u8", (FOLD_WORDS,))])


def sketch_entries(rep: np.ndarray, codes: pa.BinaryArray, universe: int) -> np.ndarray:
    """What of each record travels to its cells: its number, its size and a fold of its bits."""
    out = np.empty(len(rep), ENTRY)
    for lo in range(0, len(rep), 8192):
        words, sizes = bit_words(codes.slice(lo, 8192), universe)
        out["rep"][lo : lo + 8192], out["size"][lo : lo + 8192], out["fold"][lo : lo + 8192] = rep[lo : lo + 8192], sizes, folded(words, FOLD_WORDS)
    return out


OWN, ASKING, SECOND, ASKED = range(4)  # what a record is in a group: compared with the others of its kind and the asking; asking; of the second block; asked only


class Grid:
    """Where the records of cells are compared: in one group a cell, or, where a cell is large, in one for each pair of blocks. Groups are dealt to
    partitions by the work they are, largest first."""

    def __init__(self, own: np.ndarray, asking: np.ndarray, block_rows: int, least_parts: int, rows_per_part: int = 150_000):
        self.own_blocks, self.asking_blocks = (np.maximum(1, -(-n // block_rows)).astype(np.int64) for n in (own, asking))
        self.large = (self.own_blocks > 1) | (self.asking_blocks > 1)
        groups = np.where(self.large, self.own_blocks * (self.own_blocks + self.asking_blocks), 1)
        self.first = np.concatenate([[0], np.cumsum(groups)])
        cell = np.repeat(np.arange(len(own)), groups)
        mine, theirs = (own / self.own_blocks)[cell], (asking / self.asking_blocks)[cell]
        work = (mine + theirs) * 20 + mine * (mine / 2 + theirs)
        self.parts = int(max(least_parts, -(-(mine + theirs).sum() // rows_per_part), 1))
        self.part = np.zeros(len(cell), np.int64)
        loads = [(0.0, k) for k in range(self.parts)]
        for g in np.argsort(-work, kind="stable"):
            load, k = heapq.heappop(loads)
            self.part[g] = k
            heapq.heappush(loads, (load + float(work[g]), k))

    def deal(self, cell: np.ndarray, record: np.ndarray, salt: np.ndarray, asking: bool) -> tuple[np.ndarray, np.ndarray]:
        """(group * 4 + kind, record) of every copy: within a large cell a record stands in one block and meets all blocks."""
        plain = ~self.large[cell]
        keys, records = [self.first[cell[plain]] * 4 + (ASKING if asking else OWN)], [record[plain]]
        for c in np.unique(cell[~plain]):
            at = np.flatnonzero(cell == c)
            n, m, base = int(self.own_blocks[c]), int(self.asking_blocks[c]), int(self.first[c])
            block = (salt[at] % np.uint64(m if asking else n)).astype(np.int64)
            if asking:
                copies = [(base + n * n + block * n + i) * 4 + ASKING for i in range(n)]
            else:
                copies = [(base + np.minimum(block, j) * n + np.maximum(block, j)) * 4 + np.where(block == j, OWN, np.where(block < j, ASKED, SECOND)) for j in range(n)]
                copies += [(base + n * n + k * n + block) * 4 + ASKED for k in range(m)]
            keys += copies
            records += [record[at]] * len(copies)
        return np.concatenate(keys), np.concatenate(records)


def cell_sizes(assigned: DataFrame, cells: int, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many records (with ``cells``, the ``homes`` first) live in each of ``cells`` cells, and how many others ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asking = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            _, place, flat = _flat(b.column(0))
            own += np.bincount(flat[place < homes], minlength=cells)
            asking += np.bincount(flat[place >= homes], minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(own), pa.array(asking)], ["cell", "own", "asking"])

    own, asking = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in assigned.select("cells").mapInArrow(run, "cell bigint, own bigint, asking bigint").groupBy("cell").agg(F.sum("own"), F.sum("asking")).collect():  # as many rows as cells
        own[r[0]], asking[r[0]] = r[1], r[2]
    return own, asking


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its list, value) of all values."""
    counts = lists.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts), lists.flatten().to_numpy().astype(np.int64)


def routed_pairs(assigned: DataFrame, cells: int, homes: int, rule: Rule, *, universe: int, block_rows: int = 32768, chunk: int = 40_000) -> DataFrame:
    """Pairs ``a < b`` of records (``rep``, ``code``, ``cells`` array<int>, the ``homes`` first) of which one asks for a home cell of the other and whose folds
    don't rule them out, each once or a few times.

    Each record lives in its home cells and asks in all of its cells. Number, size and fold travel, packed for each group of a cell and side into one
    value; folds never differ in more bits than the sets do, so no pair that holds the rule is lost here. No task holds more than two
    blocks of a cell at a time, however hot it is.
    """
    spark = assigned.sparkSession
    grid = Grid(*cell_sizes(assigned, cells, homes), block_rows, shuffle_width(spark))
    shared = spark.sparkContext.broadcast(grid)  # as many numbers as cells, and groups of hot ones

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rep = whole_column(held, "rep").to_numpy()
            entries = sketch_entries(rep, whole_column(held, "code"), universe)
            row, place, flat = _flat(whole_column(held, "cells"))
            salt = _mixed(rep.view(np.uint64))
            dealt = [grid.deal(flat[side], row[side], salt[row[side]] >> np.uint64(shift), asking) for side, shift, asking in ((place < homes, 0, False), (place >= homes, 20, True))]
            key, record = (np.concatenate(x) for x in zip(*dealt))
            order = np.argsort(key, kind="stable")
            key = key[order]
            data = entries[record[order]].view(np.uint8).reshape(-1)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            offsets = np.append(new, len(key)).astype(np.int64) * ENTRY.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(grid.part[key[new] >> 2].astype(np.int32)), pa.array(key[new]), blobs], ["part", "key", "entries"])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= chunk:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, blobs = whole_column(held, "key").to_numpy(), whole_column(held, "entries")
        order, out = np.argsort(key, kind="stable"), []
        ends_ = np.flatnonzero(np.concatenate([key[order][1:] >> 2 != key[order][:-1] >> 2, [True]])) + 1
        start = 0
        for end in ends_:
            rows = order[start:end]
            start = end
            whole = np.concatenate([np.frombuffer(blobs[int(k)].as_buffer(), ENTRY) for k in rows])
            kinds = np.repeat(key[rows] & 3, [len(blobs[int(k)].as_buffer()) // ENTRY.itemsize for k in rows])
            own, asking, second, asked = (np.flatnonzero(kinds == k) for k in (OWN, ASKING, SECOND, ASKED))
            fold, size, rep = np.ascontiguousarray(whole["fold"]), whole["size"].astype(np.int64), whole["rep"]
            for left, right in ((own, None), (second, asked), (asking, np.concatenate([own, asked]))):
                for i, j in near_pairs(fold, size, left, right, rule, None):
                    a, b = rep[i], rep[j]
                    near = (a != b) & (np.bitwise_count(fold[i] ^ fold[j]).sum(1) <= rule.most_apart(size[i].astype(float), size[j].astype(float)) + 1e-9)
                    out.append(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])]))
        if out:
            flat = np.concatenate(out, axis=1)
            order = np.lexsort((flat[1], flat[0]))
            flat = flat[:, order]
            fresh = np.concatenate([[True], (np.diff(flat, axis=1) != 0).any(0)]) if flat.shape[1] else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(flat[0, fresh]), pa.array(flat[1, fresh])], ["a", "b"])

    laid = assigned.select("rep", "code", "cells").mapInArrow(pack, "part int, key bigint, entries binary")
    return laid.repartitionById(grid.parts, F.col("part")).select("key", "entries").mapInArrow(meet, "a bigint, b bigint")


COPY = np.dtype([("key", "<u4"), ("size", "<u2"), ("after", "<u2"), ("rep", "<i8"), ("fold", "<u8", (2,))])
HOT_BUCKETS = 1 << 17  # classes of cells that are counted first; only cells of large classes are counted one by one


def _cells_of(batches: list[pa.RecordBatch], turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, first content that follows it, number of those) of every cell of rows with ``cold``, ``rare`` and ``contents`` (see ``Segments.prefixes``), and all contents.
    With ``rounds``, of those cells whose turn it is."""
    cold, rare, contents = (whole_column(batches, c) for c in ("cold", "rare", "contents"))
    cold, rare, n = cold.to_numpy(), rare.to_numpy(), contents.value_lengths().to_numpy()
    row, place, value = _flat(contents)
    value = value.astype(np.uint64)
    at = np.flatnonzero((place < np.minimum(rare, n - 1)[row]) & ((value >> np.uint64(7)) % np.uint64(rounds) == turn))  # the first content that a pair shares is never the last of a prefix
    rows, cells, after = [row[at]], [_mixed(value[at])], [np.where(place[at] < cold[row[at]], 0, n[row[at]] - place[at] - 1)]
    starts = np.cumsum(n) - n + rare
    for k in np.unique(n - rare):  # rows with equally many frequent contents at once
        if k > 1:
            some = np.flatnonzero(n - rare == k)
            common = value[starts[some][:, None] + np.arange(k)]
            x, y = np.triu_indices(k, 1)
            cell = _mixed((common[:, x] << np.uint64(32) | common[:, y] & np.uint64(0xFFFFFFFF)) + np.uint64(1)).ravel()
            mine = np.flatnonzero((cell >> np.uint64(7)) % np.uint64(rounds) == turn)
            rows.append(np.repeat(some, len(x))[mine])
            cells.append(cell[mine])
            after.append(np.zeros(len(rows[-1]), np.int64))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate([at + 1, *(np.zeros(len(x), np.int64) for x in rows[1:])]), np.concatenate(after), value


def hot_cells(sketched: DataFrame, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells of over ``block_rows`` records with the number of blocks they are cut into (fewer than copies / block_rows come to the driver), and the number of copies."""
    buckets = np.uint64(HOT_BUCKETS - 1)
    contents = sketched.select("cold", "rare", "contents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(HOT_BUCKETS, np.int64)
        for b in batches:
            counts += np.bincount((_cells_of([b])[1] & buckets).astype(np.int64), minlength=HOT_BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    counts = checkpointed(contents.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    warm = np.zeros(HOT_BUCKETS, bool)
    warm[[r[0] for r in counts.where(F.col("n") > block_rows).select("bucket").collect()]] = True
    if not warm.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), total

    def of_warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _cells_of([b])[1]
            yield pa.RecordBatch.from_arrays([pa.array(cell[warm[(cell & buckets).astype(np.int64)]].view(np.int64))], ["cell"])

    hot = contents.mapInArrow(of_warm, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).collect()
    hot.sort()
    return np.array([r[0] for r in hot], np.int64), np.array([-(-r[1] // block_rows) for r in hot], np.int64), total


def runs_of(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of equal values."""
    new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.empty(0, np.int64)
    return new, np.diff(np.append(new, len(order)))


def near_in_runs(folds: np.ndarray, sizes: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rule: Rule, most: int = 512, together: int = 32_768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of records whose folds (of two words) are near enough for the rule, within each run ``at[start : start + length]``; runs are ordered by size.

    Many runs are compared at once, in their order of length: the last record of each with all before it, then the one before the last. Runs of over
    ``most`` records are compared tile by tile, one after the other.
    """
    for s, n in zip(starts[lengths > most], lengths[lengths > most]):
        mine = at[s : s + n]
        for i, j in near_pairs(folds[mine], sizes[mine], np.arange(n), None, rule, None):
            yield mine[i], mine[j]
    kept = np.flatnonzero((lengths > 1) & (lengths <= most))
    kept = kept[np.argsort(-lengths[kept], kind="stable")]
    starts, lengths = starts[kept], lengths[kept]
    sizes_ = np.arange(int(sizes.max(initial=0)) + 1, dtype=float)
    limit = np.minimum(128, np.maximum(rule.most_apart(sizes_, sizes_), rule.most_apart(rule.narrowest(sizes_).clip(0), sizes_)) + 1e-9).astype(np.uint8)  # to a set that isn't larger
    lo, words = 0, [np.ascontiguousarray(folds[:, k]) for k in range(2)]
    apart, bits, more, near = np.empty(2 * together, np.uint64), *(np.empty((2, 2 * together), np.uint8)), np.empty(2 * together, bool)  # new arrays for each step would cost more than the steps
    while lo < len(starts):
        longest = int(lengths[lo])
        hi = min(len(starts), lo + max(1, together // longest))
        place = at[np.minimum(starts[lo:hi] + np.arange(longest)[:, None], starts[lo:hi] + lengths[lo:hi] - 1)]
        fold, other, far = words[0][place], words[1][place], limit[sizes[place]]
        reach = np.searchsorted(-lengths[lo:hi], -np.arange(longest), "left")  # runs of over j records
        found_i, found_j = [], []
        for j in range(longest - 1, 0, -1):
            n = int(reach[j])
            x, y, z = (a[: j * n].reshape(j, n) for a in (apart, bits, more))
            np.bitwise_count(np.bitwise_xor(fold[:j, :n], fold[j, :n], out=x), out=y)
            np.bitwise_count(np.bitwise_xor(other[:j, :n], other[j, :n], out=x), out=z)
            np.less_equal(np.add(y, z, out=y), far[j, :n], out=near[: j * n].reshape(j, n))
            hits = np.flatnonzero(near[: j * n])
            if len(hits):
                i, run = np.divmod(hits, n)
                found_i.append(place[i, run])
                found_j.append(place[j, run])
        if found_i:
            yield np.concatenate(found_i), np.concatenate(found_j)
        lo = hi


def sketch_pairs(sketched: DataFrame, rule: Rule, *, block_rows: int = 32768, direct: int = 600, rounds: int = 8, chunk: int = 40_000) -> DataFrame:
    """Pairs ``a < b`` of (``rep``, ``size``, ``f0``, ``f1``, ``cold``, ``rare``, ``contents``) that share a cell and whose folds don't rule them out, each once.

    Only a 128-bit fold and the size travel to the cells, packed for each partition into one value; and only those of one class of cells at a time, so that
    of the many copies of a record a fraction is on disk at once. The fold never differs in more bits than the sets do in elements, so no pair
    that holds the rule is lost here; nearly all others are. A cell of over ``block_rows`` records is cut into blocks, and each pair of blocks is a group of
    its own. Cells whose keys collide are compared as one, which loses nothing. With a content that isn't ``cold`` travel those that follow it: where over
    ``direct`` records meet, only those that share a second one are compared, unless this is more work.
    """
    spark = sketched.sparkSession
    hot, blocks, total = hot_cells(sketched, block_rows)
    shared = spark.sparkContext.broadcast((hot, blocks))
    parts = max(shuffle_width(spark), -(-total // (rounds * 200_000)), 1)

    def pack(turn: int):
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rep, size, f0, f1 = (whole_column(held, c).to_numpy() for c in ("rep", "size", "f0", "f1"))
            row, cell, start, after, contents = _cells_of(held, turn, rounds)
            side = np.zeros(len(cell), np.uint32)  # 2: a pair of blocks; 1: of the second block
            hot, blocks = shared.value
            if len(hot):
                at = np.minimum(np.searchsorted(hot, cell.view(np.int64)), len(hot) - 1)
                warm = hot[at] == cell.view(np.int64)
                kept, cells, sides = [np.flatnonzero(~warm)], [cell[~warm]], [side[~warm]]
                r, c, g = np.flatnonzero(warm), cell[warm], blocks[at[warm]]
                block = (_mixed(rep[row[r]].view(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
                for other in range(int(g.max(initial=0))):
                    k = np.flatnonzero(g > other)
                    low, high = np.minimum(block[k], other), np.maximum(block[k], other)
                    kept.append(r[k])
                    cells.append(_mixed(c[k] ^ _mixed((low * (1 << 20) + high).view(np.uint64))))
                    sides.append(np.where(low == high, 0, 2 + (block[k] > other)).astype(np.uint32))
                kept, cell, side = (np.concatenate(x) for x in (kept, cells, sides))
                row, start, after = row[kept], start[kept], after[kept] * (side == 0)
            part = ((cell >> np.uint64(34)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            row, part, start, after = row[order], part[order], start[order], after[order]
            data = np.empty(len(row), COPY)
            data["key"], data["size"], data["rep"], data["after"] = ((cell[order] & np.uint64(0x3FFFFFFF)) << np.uint64(2)).astype(np.uint32) | side[order], size[row], rep[row], after
            data["fold"][:, 0], data["fold"][:, 1] = f0[row].view(np.uint64), f1[row].view(np.uint64)
            ends = np.append(0, np.cumsum(after))
            follow = contents[np.repeat(start - ends[:-1], after) + np.arange(ends[-1])].astype(np.uint16)  # their low bits
            new, _ = runs_of(part)
            bounds = np.append(new, len(part))
            blobs = [pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((where * x.itemsize).astype(np.int32)), pa.py_buffer(x.view(np.uint8).reshape(-1))]) for x, where in ((data, bounds), (follow, ends[bounds]))]
            return pa.RecordBatch.from_arrays([pa.array(part[new]), *blobs], ["part", "copies", "follow"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    n += b.num_rows
                if n >= chunk:
                    yield packed(held)
                    held, n = [], 0
            if held:
                yield packed(held)

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.frombuffer(x.as_buffer(), kind) for x in b.column(k)] for b in batches for k, kind in ((0, COPY), (1, "<u2"))]
        if not held:
            return
        flat = near_copies(np.concatenate([x for c in held[::2] for x in c]), np.concatenate([x for c in held[1::2] for x in c]), rule, direct)
        yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1])], ["a", "b"])

    found = None
    for turn in range(rounds):
        laid = sketched.mapInArrow(pack(turn), "part int, copies binary, follow binary").repartitionById(parts, F.col("part")).select("copies", "follow")
        some = checkpointed(laid.mapInArrow(meet, "a bigint, b bigint"))
        found = some if found is None else found.unionByName(some)
        del laid
        release(spark)
    return found.distinct()


def near_copies(copies: np.ndarray, follow: np.ndarray, rule: Rule, direct: int) -> np.ndarray:
    """Pairs (smaller, larger ``rep``), each once, of copies of one group whose folds don't rule them out; ``follow`` has what follows each copy, in their order."""
    key, rep, after = copies["key"], copies["rep"].copy(), copies["after"].astype(np.int64)
    size, folds, out = copies["size"].astype(np.int64), np.ascontiguousarray(copies["fold"]), [np.empty((2, 0), np.int64)]
    first_of = np.cumsum(after) - after

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        apart = np.bitwise_count(folds[i] ^ folds[j]).sum(1, dtype=np.int64)
        near = apart <= rule.most_apart(size[i].astype(float), size[j].astype(float)) + 1e-9
        a, b = rep[i[near]], rep[j[near]]
        other = a != b
        out.append(np.stack([np.minimum(a, b)[other], np.maximum(a, b)[other]]))

    group = (key >> np.uint32(1)).astype(np.uint64) << np.uint64(1) | (after > 0)  # what has contents that follow shares nothing with what hasn't
    order = np.argsort(group << np.uint64(16) | size.astype(np.uint64))
    starts, lengths = runs_of(group[order])
    between = key[order[starts]] & 2 > 0
    for s, n in zip(starts[between], lengths[between]):  # pairs of blocks
        at = order[s : s + n]
        second = (key[at] & 1).astype(bool)
        for i, j in near_pairs(folds[at], size[at], np.flatnonzero(~second), np.flatnonzero(second), rule, None):
            keep(at[i], at[j])
    large = np.flatnonzero(~between & (lengths > direct) & (after[order[starts]] > 0))
    left = ~between
    while len(large):  # about two million contents at a time
        n_follow = np.add.reduceat(after[order], starts)[large]
        some = large[: max(1, int(np.searchsorted(np.cumsum(n_follow), 2_000_000)))]
        large = large[len(some) :]
        at = order[np.repeat(starts[some] - (np.cumsum(lengths[some]) - lengths[some]), lengths[some]) + np.arange(lengths[some].sum())]
        mine = np.repeat(np.arange(len(some)), lengths[some])
        ends = np.cumsum(after[at])
        content = follow[np.repeat(first_of[at] - (ends - after[at]), after[at]) + np.arange(ends[-1])].astype(np.uint64)
        cell = np.repeat(mine, after[at]).astype(np.uint64) << np.uint64(16) | content
        member = np.repeat(at, after[at])
        sort = np.argsort(cell << np.uint64(16) | size[member].astype(np.uint64))
        cell, member = cell[sort], member[sort]
        s, n = runs_of(cell)
        owner = (cell[s] >> np.uint64(16)).astype(np.int64)
        fewer = np.bincount(owner, n * (n - 1) / 2, len(some)) < lengths[some] * (lengths[some] - 1) / 2
        left[some[fewer]] = False
        for i, j in near_in_runs(folds, size, member, s[fewer[owner]], n[fewer[owner]], rule):
            keep(i, j)
    for i, j in near_in_runs(folds, size, order, starts[left], lengths[left], rule):
        keep(i, j)
    flat = np.concatenate(out, axis=1)
    flat = flat[:, np.lexsort((flat[1], flat[0]))]
    return flat[:, np.concatenate([[True], (np.diff(flat, axis=1) != 0).any(0)])] if flat.shape[1] else flat


class Segments:
    """Cells in which every two sets of a Jaccard rule meet, without exception.

    The positions are dealt to ``m`` segments. Two sets that differ in at most ``d`` elements agree on all of at least ``m - d`` segments, so if each
    orders its segments' contents by one order of all contents, the first two they share are among the first ``d + 2`` of both. The order puts the rarest first.
    A rare content is a cell. Frequent ones make cells two by two: if the first content that a pair shares is frequent, so is the second. What is frequent
    follows from a content's estimated share of ``sets`` sets: about ``frequent`` sets or more have it; fewer than ``cold`` have a cold one.
    ``m`` and ``d`` follow the sizes: there is a band for each doubling of the size, and a pair meets in the band of its larger set.
    """

    def __init__(self, rule: Rule, sample: list[bytes], largest: int, universe: int, sets: int = 0, frequent: int = 32768, cold: int = 600):
        if rule.kind != "jaccard":
            raise ValueError("segments are for jaccard")
        rows, pos, _ = decode(pa.array(sample, pa.binary()), universe)
        p = (np.bincount(pos, minlength=universe) + 0.5) / (len(sample) + 1)
        self.rule, self.universe, self.bands = rule, universe, []
        self.weight = np.round(1000 * np.log(p / (1 - p))).astype(np.int64)
        self.common, self.warm = (-1000 * np.log(max(1.0, 0.2 * sets / n)) if sets else np.inf for n in (frequent, cold))  # costs above them are frequent, or not cold; an empty segment is about a fifth of all
        by_count = np.argsort(np.argsort(-p, kind="stable"), kind="stable")
        high = largest
        while high >= 1:
            low = high // 2 + 1
            apart = self.apart(np.array([high]), high)[0]
            m = int(apart + 2)
            self.bands.append((low, high, m, by_count % m))
            high = low - 1
        r = np.random.default_rng(0)
        self.marks = r.integers(0, 2**63, universe, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = r.integers(0, 2**63, (len(self.bands), universe + 2), dtype=np.uint64)

    def apart(self, n: np.ndarray, high: int) -> np.ndarray:
        """Most elements in which a set of size ``n`` and a partner of at most ``high`` may differ."""
        return np.floor(self.rule.most_apart(n.astype(float), np.minimum(self.rule.widest(n), high)) + 1e-9).astype(np.int64)

    def prefixes(self, codes: pa.BinaryArray) -> tuple[np.ndarray, pa.RecordBatch]:
        """(set, and for it ``cold``, ``rare`` and ``contents``) for each band of every set: 32-bit hashes of its first ``d + 2`` contents, of which so many are cold and so many rare."""
        rows, pos, n = decode(codes, self.universe)
        found: list[tuple[np.ndarray, ...]] = []
        for k, (low, high, m, segment) in enumerate(self.bands):
            mine = np.flatnonzero((n <= high) & (self.rule.widest(n) >= low))
            if not len(mine):
                continue
            slot = np.full(len(codes), -1)
            slot[mine] = np.arange(len(mine))
            inside = slot[rows] >= 0
            at = slot[rows[inside]] * m + segment[pos[inside]]
            cost, content = np.zeros(len(mine) * m, np.int64), np.zeros(len(mine) * m, np.uint64)
            np.add.at(cost, at, self.weight[pos[inside]])
            np.add.at(content, at, self.marks[pos[inside]])
            content = _mixed(content.reshape(-1, m) ^ self.salts[k, :m]) >> np.uint64(32)
            cost = cost.reshape(-1, m)
            order = np.argsort(cost * 4096 + np.arange(m), axis=1)
            first, cost = np.take_along_axis(content, order, 1), np.take_along_axis(cost, order, 1)
            inside = np.arange(m) < (self.apart(n[mine], high) + 2)[:, None]
            found.append((mine, (inside & (cost <= self.warm)).sum(1), (inside & (cost <= self.common)).sum(1), inside.sum(1), first[inside]))
        row, cold, rare, n, contents = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(contents.astype(np.uint32).view(np.int32)))
        return row, pa.RecordBatch.from_arrays([pa.array(cold.astype(np.int32)), pa.array(rare.astype(np.int32)), lists], ["cold", "rare", "contents"])

    def cells(self, codes: pa.BinaryArray) -> list[np.ndarray]:
        owner, prefixes = self.prefixes(codes)
        row, cell, *_ = _cells_of([prefixes])
        row = owner[row]
        order = np.argsort(row, kind="stable")
        return np.split(cell[order].view(np.int64), np.cumsum(np.bincount(row, minlength=len(codes)))[:-1]) if len(codes) else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def verified(pairs: DataFrame, distinct: DataFrame, rule: Rule, universe: int) -> DataFrame:
    """Of pairs (``a``, ``b``) those that hold the rule, with ``o``, ``na`` and ``nb``."""
    codes = distinct.select("rep", "code")
    both = pairs.join(codes.select(F.col("rep").alias("a"), F.col("code").alias("xa")), "a").join(codes.select(F.col("rep").alias("b"), F.col("code").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (wa, na), (wb, nb) = bit_words(b.column(2), universe), bit_words(b.column(3), universe)
            o = np.bitwise_count(wa & wb).sum(1).astype(np.int64)
            good = np.flatnonzero(rule.holds(o, na, nb))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good)), *(pa.array(x[good].astype(np.int32)) for x in (o, na, nb))], ["a", "b", "o", "na", "nb"])

    return both.select("a", "b", "xa", "xb").mapInArrow(run, PAIRS)


def small(rows: DataFrame) -> DataFrame:
    """``rows`` of two numbers each, to be sent to all executors if they are at most a fifth of ``BROADCAST_ROWS``; else as they are, to be joined by shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS // 5 else rows


def expanded(pairs: DataFrame, copies: DataFrame, a: str, b: str, *also: str) -> DataFrame:
    """Pairs of rows from pairs of representatives and (``rep``, ``row``) of sets that stand in several rows."""
    left = pairs.join(copies.select(F.col("rep").alias("a"), F.col("row").alias("ra")), "a", "left")
    both = left.join(copies.select(F.col("rep").alias("b"), F.col("row").alias("rb")), "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return both.select(F.least(x, y).alias(a), F.greatest(x, y).alias(b), *also)


def copy_rows(encoded: DataFrame, distinct: DataFrame) -> DataFrame:
    """(``rep``, ``row``) of every set that stands in several rows; a row given twice comes once."""
    several = distinct.where("rows > 1").select("code", "rep")
    if several.count() <= BROADCAST_ROWS // 5:  # a code is longer than an id
        several = F.broadcast(several)
    return encoded.join(several, "code").select("rep", "row").distinct()


def copy_counts(members: DataFrame) -> DataFrame:
    """(``rep``, ``copies``) of sets that stand in several different rows."""
    return members.groupBy("rep").agg(F.count("*").alias("copies")).where("copies > 1")


def copy_pairs(copies: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of rows of equal sets, each once."""
    other = copies.select("rep", F.col("row").alias("other"))
    return copies.join(other, "rep").where("row < other").select(F.col("row").alias(a), F.col("other").alias(b))


def rounded_cosine() -> Column:
    return F.round(F.col("o") / F.sqrt(F.col("na") * F.col("nb")), 6)


def sample_codes(distinct: DataFrame, n: int, seed: int = 0) -> list[bytes]:
    """At most ``n`` codes, spread by hash; the same for the same sets, whatever their order."""
    return [bytes(r[0]) for r in distinct.select("code").orderBy(F.xxhash64("code", F.lit(seed)), "code").limit(n).collect()]


def _lists(cells: list[np.ndarray], kind: type = np.int32) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in cells])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cells).astype(kind) if cells else np.empty(0, kind)))


def map_codes(distinct: DataFrame, route: Callable[[pa.BinaryArray], list[np.ndarray]]) -> DataFrame:
    """(``rep``, ``code``, ``cells``): what ``route`` gives for each code of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(route(b.column(1)))], ["rep", "code", "cells"])

    return distinct.select("rep", "code").mapInArrow(run, "rep bigint, code binary, cells array<int>")


def map_sketches(distinct: DataFrame, prefixes: Callable[[pa.BinaryArray], tuple[np.ndarray, pa.RecordBatch]], universe: int) -> DataFrame:
    """(``rep``, ``size``, ``f0``, ``f1``, ``cold``, ``rare``, ``contents``): size and 128-bit fold of each set, for each of its ``prefixes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                words, sizes = bit_words(part.column(1), universe)
                folds = folded(words, 2).view(np.int64)
                row, more = prefixes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(sizes.astype(np.int32)[row]), pa.array(folds[row, 0]), pa.array(folds[row, 1]), *more.columns], ["rep", "size", "f0", "f1", *more.schema.names])

    return distinct.select("rep", "code").mapInArrow(run, "rep bigint, size int, f0 bigint, f1 bigint, cold int, rare int, contents array<int>")

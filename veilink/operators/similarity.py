"""Soft-cosine similarity of all records of two tables, in blocks.

Filters are packed into bits and both tables into blocks of rows, which are stored once; each pair of blocks is a task that reads both, so neither
table is ever broadcast, held whole or copied for the blocks of the other. What a task finds leaves it strip by strip. Counts are exact and are divided in
double precision, so that a threshold and a similarity of the same two filters are the same number.

Where only pairs above some similarity matter, filters are folded onto 512 positions first: two filters share at most as many positions as their
folds and the positions that the fold merged in one of them, and only pairs that can reach the similarity so are counted in full. None is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, slots

if TYPE_CHECKING:
    from .embed import Embedded, Embedder

BLOCK_ROWS = 4096
STRIP_ROWS = 64  # rows of a block whose scores are held at once
MOST_BLOCKS = 16  # blocks of ``block_rows`` that are joined into one where tables are large
FOLD = 512  # positions of a fold
FOLD_ROWS, FOLD_COLUMNS = 768, 1024  # rows whose folds are compared at once, three in a row of floats: three counts below 256 fit into one
INDEX_COST = 8  # joining an entry of the inverted index takes as long as comparing so many pairs in blocks, or longer
MOST_WIDTH = 65_536  # of filters that are compared in blocks instead
CANDIDATES = 8192  # pairs that are counted in full at once
PRICE_ERROR = 1e-9  # by which a pair may exceed the prices of its records
NEVER = 1 << 20  # more positions than any pair is asked to share


def padded(width: int) -> int:
    return -(-max(1, width) // FOLD) * FOLD


def bits_of(lists: pa.ListArray, width: int) -> np.ndarray:
    """Packed bits of index lists, a row each; repeated indices count once, null lists are empty."""
    out, rows = np.zeros((len(lists), padded(width) // 8), np.uint8), 1024
    for lo in range(0, len(lists), rows):
        part = lists.slice(lo, rows)
        sizes, values = np.asarray(part.value_lengths().fill_null(0)), np.asarray(part.flatten()).astype(np.int64)
        if len(values) and not 0 <= values.min() <= values.max() < width:
            raise ValueError(f"an index lies outside 0 to {width - 1}")
        dense = np.zeros((len(part), padded(width)), np.uint8)
        dense[np.repeat(np.arange(len(part)), sizes), values] = 1
        out[lo : lo + rows] = np.packbits(dense, axis=1)
    return out


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


class Block:
    """Rows of a table: ids, packed bits and what is carried along, as an Arrow stream holds them."""

    def __init__(self, data: bytes):
        with pa.ipc.open_stream(data) as stream:
            self.table = stream.read_all().combine_chunks()
        self.ids = self.table["id"].combine_chunks() if self.table["id"].num_chunks != 1 else self.table["id"].chunk(0)
        n = self.table.num_rows
        self.bits = np.frombuffer(b"".join(self.table["bits"].to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, FOLD // 8), np.uint8)
        self.words = self.bits.view(np.uint64)
        self.count = np.bitwise_count(self.words).sum(1, dtype=np.int64)

    def __len__(self) -> int:
        return self.table.num_rows

    def folds(self, lo: int, hi: int) -> np.ndarray:
        """0/1 matrix of the folds of some rows."""
        b = self.bits[lo:hi]
        return unpacked(np.bitwise_or.reduce(b.reshape(len(b), -1, FOLD // 8), axis=1))

    def in_order(self) -> "Block":
        """With rows in the order of their counts, so that those of a strip need about the same."""
        order = np.argsort(self.count, kind="stable")
        self.table, self.ids = self.table.take(pa.array(order)), self.ids.take(pa.array(order))
        self.bits, self.count = np.ascontiguousarray(self.bits[order]), self.count[order]
        self.words = self.bits.view(np.uint64)
        return self


def _stream(batches: list[pa.RecordBatch] | pa.Table, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for b in batches.to_batches() if isinstance(batches, pa.Table) else batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def packed_rows(df: DataFrame, id_column: str, width: int, carry: list[str], block_rows: int) -> DataFrame:
    """(``n``, ``block``) of the rows with an id: up to ``block_rows`` rows each, checkpointed."""
    chosen = df.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").alias("id"), F.col("bf_indices").cast("array<int>").alias("x"), *[F.col(c) for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_stream(held, held[0].schema)], pa.binary())], ["n", "block"])

        for whole in batches:
            for lo in range(0, whole.num_rows, block_rows):
                b = whole.slice(lo, block_rows)
                bits = bits_of(b.column(1), width)
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())])
                if n and n + b.num_rows > block_rows:
                    yield out()
                    held, n = [], 0
                held.append(pa.RecordBatch.from_arrays([b.column(0), column, *[b.column(k) for k in range(2, b.num_columns)]], ["id", "bits", *carry]))
                n += b.num_rows
        if n:
            yield out()

    return checkpointed(chosen.mapInArrow(run, "n bigint, block binary"))


def row_count(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def blocks_of(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(``at``, ``block``) of about ``size`` rows, one in each partition, checkpointed: every task reads the two it compares from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for b in batches for x in b.column(0)]
        if parts:
            whole = pa.concat_tables(parts)
            yield pa.RecordBatch.from_arrays([pa.array([_stream(whole.combine_chunks(), whole.schema)], pa.binary())], ["block"])

    return checkpointed(rows.select("block").repartition(max(1, -(-n // size))).mapInArrow(run, "block binary").select(F.spark_partition_id().alias("at"), "block"))


def block_pairs(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """(``i``, ``j``, ``x``, ``y``): every block of ``left`` with every block of ``right`` and their numbers, each pair in a task of its own."""
    n, m = row_count(left), row_count(right)
    even = int((n * m / (2 * slots(left.sparkSession))) ** 0.5)  # two tasks a slot
    size = min(max(even, min(block_rows, 1024)), MOST_BLOCKS * block_rows)
    a = blocks_of(left, n, size)
    b = a if right is left else blocks_of(right, m, size)
    # a product of partitions: what is checkpointed is read by each task, nothing is shuffled
    both = a.select(F.col("at").alias("i"), F.col("block").alias("x")).hint("shuffle_replicate_nl").crossJoin(b.select(F.col("at").alias("j"), F.col("block").alias("y")))
    return both.select("i", "j", "x", "y")


def _scores(x: np.ndarray, y: np.ndarray, scm: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """First row and similarities of a strip of rows of ``x`` with all of ``y``, strip by strip."""
    if scm is None:
        na, nb = x.sum(1, dtype=np.float64), y.sum(1, dtype=np.float64)
        right = y.T
    else:
        na, nb = (np.maximum(0, ((m @ scm) * m).sum(1, dtype=np.float64)) for m in (x, y))
        right = (y @ scm).T
    for lo in range(0, len(x), STRIP_ROWS):
        counts = (x[lo : lo + STRIP_ROWS] @ right).astype(np.float64)
        # one root of a product of counts, so that equal filters score exactly 1; of trained norms each its own
        norms = np.sqrt(na[lo : lo + STRIP_ROWS, None] * nb[None, :]) if scm is None else np.sqrt(na[lo : lo + STRIP_ROWS])[:, None] * np.sqrt(nb)[None, :]
        yield lo, np.divide(counts, norms, out=np.zeros(counts.shape), where=norms > 0)


def all_scores(x: Block, y: Block, width: int, scm: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row of each side and the similarities of a strip of ``x`` with some of ``y``."""
    for first in range(0, len(x), BLOCK_ROWS):
        rows = unpacked(x.bits[first : first + BLOCK_ROWS])[:, :width]
        for at in range(0, len(y), BLOCK_ROWS):
            for lo, s in _scores(rows, unpacked(y.bits[at : at + BLOCK_ROWS])[:, :width], scm):
                yield first + lo, at, s


def exact(x: Block, i: np.ndarray, y: Block, j: np.ndarray) -> np.ndarray:
    """Similarities of the pairs of rows ``i`` and ``j``."""
    norms = np.sqrt(x.count[i].astype(np.float64) * y.count[j])
    ones = np.bitwise_count(x.words[i] & y.words[j]).view(np.uint64)  # at most 64 in each byte
    pair = np.uint64(0x00FF00FF00FF00FF)
    sums = np.zeros(len(i), np.uint64)
    counts = np.zeros(len(i), np.int64)
    for k in range(ones.shape[1]):
        sums += (ones[:, k] & pair) + (ones[:, k] >> np.uint64(8) & pair)
        if k % 64 == 63 or k == ones.shape[1] - 1:  # the sums of four pairs of bytes stay below 65,536
            counts += (sums * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)
            sums[:] = 0
    return np.divide(counts, norms, out=np.zeros(len(i)), where=norms > 0)


Need = Callable[[int, int, float], np.ndarray]


def candidates(x: Block, y: Block, need_y: Need, need_x: Need | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``i`` of ``x`` and ``j`` of ``y`` whose folds allow what one side needs, some at a time; none that has it is left out.

    ``need_y(lo, hi, root)``: of each row of ``y`` from ``lo`` to ``hi`` the fewest shared positions that matter beside a row of ``x`` whose count has at
    least that root; ``need_x`` the same of rows of ``x``. They are asked again for each strip, so they may rise. Both blocks must be in order of counts.
    """
    strips = []
    for at in range(0, len(x), FOLD_ROWS):
        f = x.folds(at, at + FOLD_ROWS)
        size = f.sum(1)
        third = -(-len(f) // 3)
        rows = np.zeros((3 * third, FOLD), np.float32)
        rows[: len(f)] = f
        merged = (x.count[at : at + FOLD_ROWS] - size).astype(np.int64)
        strips.append((at, len(f), rows[:third] + 256 * rows[third : 2 * third] + 65536 * rows[2 * third :], merged, np.sqrt(x.count[at]), size.max() < 256))
    most = max((len(s[2]) for s in strips), default=0) * min(FOLD_COLUMNS, len(y))
    products, whole, limits, masks = np.empty(most, np.float32), np.empty(most, np.int32), np.empty(most, np.uint32), np.empty(4 * most, bool)
    for lo in range(0, len(y), FOLD_COLUMNS):
        hi = min(len(y), lo + FOLD_COLUMNS)
        g = y.folds(lo, hi)
        lost = (y.count[lo:hi] - g.sum(1)).astype(np.int64)
        right, root_y, most_lost = np.ascontiguousarray(g.T), np.sqrt(y.count[lo]), lost.max()
        for at, n, rows, merged, root_x, fits in strips:
            least_y = np.maximum(need_y(lo, hi, root_x) - np.minimum(lost, merged.max()), 0)
            least_x = None if need_x is None else np.maximum(need_x(at, at + n, root_y) - np.minimum(merged, most_lost), 0)
            if fits:
                third, cells = len(rows), len(rows) * (hi - lo)
                shape = (third, hi - lo)
                counts = whole[:cells].reshape(shape)
                np.copyto(counts, np.matmul(rows, right, out=products[:cells].reshape(shape)), casting="unsafe")
                # a fold with 255 positions or fewer: where more are needed, those that share 255 are counted in full
                limit = np.full((hi - lo, 4), 255, np.uint8)  # of the fourth byte, which is 0
                limit[:, :3] = np.minimum(least_y, 255)[:, None]
                mask = masks[: 4 * cells].reshape(third, -1)
                if least_x is None:
                    np.greater_equal(counts.view(np.uint8), limit.ravel(), out=mask)
                else:
                    own = np.full((4, third), 255, np.uint8)
                    own[:3].ravel()[:n] = np.minimum(least_x, 255)
                    both = limits[:cells].reshape(shape)
                    both[:] = np.ascontiguousarray(own.T).view(np.uint32)
                    both = both.view(np.uint8)
                    np.greater_equal(counts.view(np.uint8), np.minimum(both, limit.ravel(), out=both), out=mask)
                some = np.flatnonzero(mask.view(np.uint32))
                row, column = np.divmod(some, hi - lo)
                k, part = np.nonzero(mask.reshape(-1, 4)[some])
                i, j = row[k] + part * third, column[k]
                there = i < n
                i, j = i[there], j[there]
            else:
                counts = x.folds(at, at + FOLD_ROWS) @ right
                i, j = np.nonzero(counts >= least_y if least_x is None else (counts >= least_y) | (counts >= least_x[:, None]))
            for k in range(0, len(i), CANDIDATES):
                yield i[k : k + CANDIDATES] + at, j[k : k + CANDIDATES] + lo


def needed(sims: np.ndarray | float, counts: np.ndarray, root: float) -> np.ndarray:
    """The fewest shared positions with which a similarity of ``sims`` can be had."""
    return np.ceil(np.maximum(sims, 0) * np.sqrt(counts) * root * (1 - 1e-9)).astype(np.int64)


def self_thresholds(embedder: "Embedder", edf: "Embedded", block_rows: int = BLOCK_ROWS) -> "Embedded":
    """``thresholds``: each record's largest similarity to another record of its own table; a lone record has minus infinity.

    Records are told apart by id; two rows of one id aren't others of each other. A row with a null id has a null threshold and is no other of any.
    """
    from .embed import Embedded

    embedder.check(edf)
    width, key = embedder.width, edf.id_column
    own = edf.df.drop("thresholds")
    kind = dict(own.dtypes)[key]
    shared = None if embedder.scm is None else own.sparkSession.sparkContext.broadcast(embedder.scm)  # width x width

    def scored(x: Block, y: Block, xs: np.ndarray, mine: np.ndarray, theirs: np.ndarray, best_x: np.ndarray, best_y: np.ndarray) -> None:
        """All similarities of the rows ``xs`` with ``y``."""
        rows = unpacked(x.bits[xs])[:, :width]
        for at in range(0, len(y), BLOCK_ROWS):
            for lo, s in _scores(rows, unpacked(y.bits[at : at + BLOCK_ROWS])[:, :width], None if shared is None else shared.value):
                i, j = xs[lo : lo + len(s)], slice(at, at + s.shape[1])
                s[mine[i][:, None] == theirs[j][None, :]] = -np.inf
                best_x[i], best_y[j] = np.maximum(best_x[i], s.max(1)), np.maximum(best_y[j], s.max(0))

    def best_of(x: Block, y: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Largest similarities of the rows of both to a row of the other."""
        codes = pd.factorize(np.concatenate([x.ids.to_numpy(zero_copy_only=False), y.ids.to_numpy(zero_copy_only=False)]))[0]
        mine, theirs = codes[: len(x)], codes[len(x) :]
        best_x = np.full(len(x), -np.inf)
        best_y = best_x if same else np.full(len(y), -np.inf)
        if shared is not None:
            for lo in range(0, len(x), BLOCK_ROWS):
                scored(x, y, np.arange(lo, min(len(x), lo + BLOCK_ROWS)), mine, theirs, best_x, best_y)
            return best_x, best_y
        # a few rows of each are scored with all of the other; what other pairs must exceed follows from that
        few = lambda b: np.unique(np.linspace(0, len(b) - 1, 256).astype(np.int64))
        scored(x, y, few(x), mine, theirs, best_x, best_y)
        scored(y, x, few(y), theirs, mine, best_y, best_x)

        def need(block: Block, best: np.ndarray) -> Need:
            def of(lo: int, hi: int, root: float) -> np.ndarray:
                # one position more than are shared so far; any, if all scored rows had the same id; empty filters share none
                more = np.floor(np.maximum(best[lo:hi], 0) * np.sqrt(block.count[lo:hi]) * root * (1 - 1e-9)).astype(np.int64) + 1
                return np.where(np.isneginf(best[lo:hi]), 0, np.where(block.count[lo:hi] == 0, NEVER, more))

            return of

        for i, j in candidates(x, y, need(y, best_y), need(x, best_x)):
            other = mine[i] != theirs[j]
            i, j = i[other], j[other]
            sims = exact(x, i, y, j)
            np.maximum.at(best_x, i, sims)
            np.maximum.at(best_y, j, sims)
        return best_x, best_y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, m, p, q in zip(*(b.column(k) for k in range(4))):
                x = Block(p.as_buffer()).in_order()
                y = x if n == m else Block(q.as_buffer()).in_order()
                best_x, best_y = best_of(x, y, n == m)
                yield pa.RecordBatch.from_arrays([x.ids, pa.array(best_x)], ["id", "best"])
                if n != m:
                    yield pa.RecordBatch.from_arrays([y.ids, pa.array(best_y)], ["id", "best"])

    rows = packed_rows(own, key, width, [], block_rows)
    # each pair of blocks once, for both of its sides
    pairs = block_pairs(rows, rows, block_rows).where("i <= j")
    best = pairs.mapInArrow(run, f"id {kind}, best double").groupBy("id").agg(F.max("best").alias("thresholds"))
    joined = own.join(best.withColumnRenamed("id", key), key, "left")
    return Embedded(joined.select(*[f"`{c}`" for c in own.columns], "thresholds"), edf.checksum, key)


def compare(embedder: "Embedder", left: "Embedded", right: "Embedded", require_thresholds: bool = True, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``id1``, ``id2``, ``sim``, ``th1``, ``th2``) of all pairs, or of those with ``sim`` at least ``least``.

    Thresholds are null unless both tables have them; that is an error if they are required. Null ids match nothing.
    """
    embedder.check(left, right)
    have = all("thresholds" in e.df.columns for e in (left, right))
    if require_thresholds and not have:
        raise ValueError("both tables need thresholds")
    width = embedder.width
    shared = None if embedder.scm is None else left.df.sparkSession.sparkContext.broadcast(embedder.scm)  # width x width
    k1, k2 = (dict(e.df.dtypes)[e.id_column] for e in (left, right))
    carry = ["thresholds"] if have else []
    packed = [packed_rows(e.df, e.id_column, width, carry, block_rows) for e in (left, right)]
    cells = row_count(packed[0]) * row_count(packed[1])
    pairs = block_pairs(*packed, block_rows)

    def found(x: Block, y: Block, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if least is None or least <= 0 or shared is not None:
            for lo, at, s in all_scores(x, y, width, shared and shared.value):
                i, j = np.nonzero(s >= least) if least is not None else map(np.ravel, np.indices(s.shape))
                yield i + lo, j + at, s[i, j]
        else:
            for i, j in candidates(x, y, lambda lo, hi, root: needed(least, y.count[lo:hi], root)):
                s = exact(x, i, y, j)
                keep = s >= least
                yield i[keep], j[keep], s[keep]

    def at_least(least: float | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, q in zip(b.column(2), b.column(3)):
                    x, y = Block(p.as_buffer()).in_order(), Block(q.as_buffer()).in_order()
                    for i, j, s in found(x, y, least) if len(x) and len(y) else ():
                        if len(i):
                            th = [side.table["thresholds"].combine_chunks().take(pa.array(at)) for side, at in ((x, i), (y, j))] if have else []
                            yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i)), y.ids.take(pa.array(j)), pa.array(s), *th], ["id1", "id2", "sim", *["th1", "th2"][: len(th)]])

        out = pairs.mapInArrow(run, f"id1 {k1}, id2 {k2}, sim double" + (", th1 double, th2 double" if have else ""))
        out = out if have else out.select("id1", "id2", "sim", F.lit(None).cast("double").alias("th1"), F.lit(None).cast("double").alias("th2"))
        out._at_least = lambda more: out if least is not None and more <= least else at_least(more)
        if least is None and shared is None:
            out._best = best
            out._cells = cells
        return out

    def best(k: int, prices: tuple[pd.Series, pd.Series] | None = None) -> DataFrame:
        """The pairs that are among the ``k`` of largest ``over`` of either record, and maybe others: the similarity, which must be positive, less the
        prices of both ids. With prices only pairs where it is positive."""
        spark = left.df.sparkSession
        known = None if prices is None else spark.sparkContext.broadcast(prices)  # a number for each id that has a price

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, q in zip(b.column(2), b.column(3)):
                    x, y = Block(p.as_buffer()), Block(q.as_buffer())
                    u, v = (np.zeros(len(z)) if known is None else z.ids.to_pandas().map(known.value[side]).fillna(0).to_numpy(np.float64) for side, z in ((0, x), (1, y)))
                    for first in range(0, len(x), FOLD_COLUMNS):
                        rows = unpacked(x.bits[first : first + FOLD_COLUMNS])
                        for at in range(0, len(y), FOLD_COLUMNS):
                            sims = np.concatenate([s for _, s in _scores(rows, unpacked(y.bits[at : at + FOLD_COLUMNS]), None)])
                            over = sims - u[first : first + len(sims), None] - v[None, at : at + sims.shape[1]]
                            keep = np.zeros(sims.shape, bool)
                            for axis in (0, 1):
                                n = min(k, sims.shape[axis])
                                np.put_along_axis(keep, np.take(np.argpartition(-over, n - 1, axis=axis), np.arange(n), axis=axis), True, axis=axis)
                            i, j = np.nonzero(keep & (sims > 0) & ((over > PRICE_ERROR) if known is not None else True))
                            th = [z.table["thresholds"].combine_chunks().take(pa.array(a)) if have else pa.nulls(len(a), pa.float64()) for z, a in ((x, i + first), (y, j + at))]
                            yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i + first)), y.ids.take(pa.array(j + at)), pa.array(sims[i, j]), *th, pa.array(over[i, j])], ["id1", "id2", "sim", "th1", "th2", "over"])

        some = pairs.mapInArrow(run, f"id1 {k1}, id2 {k2}, sim double, th1 double, th2 double, over double")
        rank = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("over")))
        return some.withColumn("r1", rank("id1")).withColumn("r2", rank("id2")).where((F.col("r1") <= k) | (F.col("r2") <= k)).drop("r1", "r2", "over")

    return at_least(least)


def compare_indexed(left: "Embedded", right: "Embedded") -> DataFrame:
    """(``id1``, ``id2``, ``sim``) of pairs with a common index, by an inverted index: for filters that are sparse and diverse.

    Where records share so many indices that the index has as many entries to join as a share of all pairs, all pairs are compared in blocks instead.
    """
    def exploded(e: "Embedded", name: str, n: str) -> DataFrame:
        x = e.df.select(F.col(e.id_column).alias(name), F.array_distinct("bf_indices").alias("x"))
        return x.select(name, F.size("x").alias(n), F.explode("x").alias("pos"))

    def keys(e: "Embedded") -> tuple[int, bool]:
        n, ids = e.df.agg(F.count("*"), F.countDistinct(e.id_column)).first()
        return n, n == ids

    a, b = exploded(left, "id1", "n1"), exploded(right, "id2", "n2")
    each = [x.groupBy("pos").agg(F.count("*").alias(name)) for x, name in ((a, "p"), (b, "q"))]
    joined, low, high = each[0].join(each[1], "pos", "full").agg(F.sum(F.col("p").cast("double") * F.col("q")), F.min("pos"), F.max("pos")).first()
    (n, alone), (m, alone2) = keys(left), keys(right)
    if (joined or 0) * INDEX_COST > n * m and alone and alone2 and low >= 0 and high < MOST_WIDTH:
        return _sharing(left, right, high + 1)
    counts = a.join(b, "pos").groupBy("id1", "id2", "n1", "n2").agg(F.count("*").alias("o"))
    return counts.select("id1", "id2", (F.col("o") / F.sqrt(F.col("n1") * F.col("n2"))).alias("sim"))


def _sharing(left: "Embedded", right: "Embedded", width: int) -> DataFrame:
    """Pairs of positive similarity, of tables whose ids are keys."""
    k1, k2 = (dict(e.df.dtypes)[e.id_column] for e in (left, right))
    pairs = block_pairs(*(packed_rows(e.df, e.id_column, width, [], BLOCK_ROWS) for e in (left, right)), BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, q in zip(b.column(2), b.column(3)):
                x, y = Block(p.as_buffer()), Block(q.as_buffer())
                for lo, at, s in all_scores(x, y, width, None):
                    i, j = np.nonzero(s)
                    yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i + lo)), y.ids.take(pa.array(j + at)), pa.array(s[i, j])], ["id1", "id2", "sim"])

    return pairs.mapInArrow(run, f"id1 {k1}, id2 {k2}, sim double")

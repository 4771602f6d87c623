"""Most similar vectors of every vector, by learned partitions.

A bounded sample of vectors gives a graph of nearest neighbours, which is cut into parts of equal size that keep neighbours
together. A small classifier (naive Bayes over positions, one weight for each position and part) learns the parts from
the sample, and once more from a larger bounded sample that it has labelled itself. Every vector of the collection is stored in the two parts that
are most probable for it and asks in five more. Where the collection is too large for that many parts, each of them is cut into further ones, learned
from what lies in and around it (``split``), so that the work for a vector doesn't grow with the collection. Folds of the bit vectors rule out what can't be similar enough without losing
any; what remains is reranked by the exact cosine.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, release, slots
from . import sets as S

SAMPLE_ROWS = 16_384  # bound of the sample that the graph and the classifier are fitted on
LABELLED_ROWS = 262_144  # bound of the sample that the classifier labels and is fitted on again
MOST_SPLIT = 128  # pieces that a part is cut into at most: a byte for each position and piece is broadcast
PIECE_ROWS = 64  # sampled vectors for each piece


def sample_graph(sample: list[bytes], universe: int, degree: int, spark) -> np.ndarray:
    """Nearest neighbours of each sampled vector within the sample (row i: indices of the ``degree`` nearest), found on the executors."""
    shared = spark.sparkContext.broadcast(sample)  # at most SAMPLE_ROWS codes
    k = min(degree, len(sample) - 1)
    tasks = max(1, min(slots(spark), len(sample) // 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pos, n = S.decode(pa.array(shared.value, pa.binary()), universe)
        unit = np.zeros((len(n), universe), np.float32)
        unit[rows, pos] = 1 / np.sqrt(n[rows])
        for b in batches:
            mine = b.column(0).to_numpy()
            for lo in range(0, len(mine), 256):
                ids = mine[lo : lo + 256]
                sim = unit[ids] @ unit.T
                sim[np.arange(len(ids)), ids] = -1
                near = np.argpartition(-sim, k - 1, axis=1)[:, :k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * k + 1, k, np.int32)), pa.array(near.ravel()))], ["id", "near"])

    ids = spark.range(0, len(sample), numPartitions=tasks)
    got = ids.mapInArrow(run, "id bigint, near array<int>").collect()
    out = np.empty((len(sample), k), np.int64)
    for r in got:
        out[r["id"]] = r["near"]
    return out


def balanced_parts(near: np.ndarray, parts: int, passes: int = 3) -> np.ndarray:
    """Part of each node. Parts grow from well-connected nodes along most shared links up to an equal size; then nodes move
    to the part that holds most of their neighbours as long as it has room."""
    n = len(near)
    size = -(-n // parts)
    links: list[set[int]] = [set() for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        links[i].update(row)
        for j in row:
            links[j].add(i)
    label = np.full(n, -1)
    part, taken = 0, 0
    heap: list[tuple[int, int]] = []
    weight: dict[int, int] = {}
    for seed in sorted(range(n), key=lambda i: (-len(links[i]), i)):
        if label[seed] >= 0:
            continue
        heapq.heappush(heap, (0, seed))
        while heap:
            w, node = heapq.heappop(heap)
            if label[node] >= 0 or -w < weight.get(node, 0):
                continue
            label[node] = part
            taken += 1
            if taken == size:
                part, taken, heap, weight = part + 1, 0, [], {}
                break
            for other in links[node]:
                if label[other] < 0:
                    weight[other] = weight.get(other, 0) + 1
                    heapq.heappush(heap, (-weight[other], other))
    filled = np.bincount(label, minlength=parts)
    for _ in range(passes):
        for i in range(n):
            around = np.bincount(label[list(links[i])], minlength=1) if links[i] else np.zeros(1, int)
            to = int(np.argmax(around))
            own = int(label[i])
            if to != own and around[to] > (around[own] if own < len(around) else 0) and filled[to] < size * 1.1 and filled[own] > size * 0.7:
                label[i] = to
                filled[to] += 1
                filled[own] -= 1
    return label


class Router:
    """Naive Bayes from sets of positions to parts, from how often each position stands in each part (``counts``) and the parts' sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, prior: float = 16.0):
        everywhere = counts.sum(1, keepdims=True) / max(1, sizes.sum())
        p = np.clip((counts + prior * everywhere) / (sizes + prior), 1e-6, 1 - 1e-6)
        self.weight = (np.log(p) - np.log1p(-p)).astype(np.float32)
        self.bias = np.log1p(-p).sum(0).astype(np.float32)

    @classmethod
    def of_sample(cls, sample: list[bytes], label: np.ndarray, parts: int, universe: int) -> "Router":
        rows, pos, _ = S.decode(pa.array(sample, pa.binary()), universe)
        counts = np.zeros((universe, parts), np.float64)
        np.add.at(counts, (pos, label[rows]), 1)
        return cls(counts, np.bincount(label, minlength=parts))

    @property
    def cells(self) -> int:
        return len(self.bias)

    def route(self, codes: pa.BinaryArray, universe: int, probes: int) -> list[np.ndarray]:
        """The ``probes`` most probable parts of each set, the most probable first."""
        k, out = min(probes, len(self.bias)), []
        for lo in range(0, len(codes), 1024):
            part = codes.slice(lo, 1024)
            rows, pos, _ = S.decode(part, universe)
            dense = np.zeros((len(part), universe), np.float32)
            dense[rows, pos] = 1
            score = -(dense @ self.weight + self.bias)
            top = np.argpartition(score, k - 1, axis=1)[:, :k] if k < len(self.bias) else np.tile(np.arange(k), (len(part), 1))
            out += list(np.take_along_axis(top, np.argsort(np.take_along_axis(score, top, 1), axis=1), 1))
        return out


def refitted(router: Router, distinct: DataFrame, n_sets: int, universe: int) -> Router:
    """``router`` fitted again on what it says of about ``LABELLED_ROWS`` vectors, picked by hash; counted on the executors."""
    spark, parts = distinct.sparkSession, len(router.bias)
    shared = spark.sparkContext.broadcast(router)
    share = min(1.0, LABELLED_ROWS / n_sets)
    picked = distinct.where(F.pmod(F.xxhash64("code", F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20))).select("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(universe * parts, np.int64), np.zeros(parts, np.int64)
        for b in batches:
            label = np.array([x[0] for x in shared.value.route(b.column(0), universe, 1)], np.int64)
            rows, pos, _ = S.decode(b.column(0), universe)
            counts += np.bincount(pos * parts + label[rows], minlength=universe * parts)
            sizes += np.bincount(label, minlength=parts)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<i4").tobytes()], pa.binary()), pa.array([sizes.astype("<i4").tobytes()], pa.binary())], ["counts", "sizes"])

    # at most 16 matrices of a position and a part each come back
    got = picked.repartition(min(16, slots(spark))).mapInArrow(run, "counts binary, sizes binary").collect()
    counts, sizes = (sum(np.frombuffer(bytes(r[k]), "<i4").astype(np.int64) for r in got) for k in ("counts", "sizes"))
    return Router(counts.reshape(universe, parts).astype(np.float64), sizes)


class SplitRouter:
    """A router whose parts are cut into ``pieces`` each. Piece ``j`` of part ``i`` is cell ``i * pieces + j``; its weights are eighths in a byte."""

    def __init__(self, coarse: Router, weight: np.ndarray, bias: np.ndarray):
        self.coarse, self.weight, self.bias = coarse, weight, bias
        self.pieces, self.cells = bias.shape[1], bias.size

    def route(self, codes: pa.BinaryArray, universe: int, probes: int, beam: int = 16) -> list[np.ndarray]:
        """The ``probes`` most probable pieces of each set, of all pieces of its ``beam`` most probable parts, the most probable first."""
        out: list[np.ndarray] = []
        for lo in range(0, len(codes), 16384):
            some = codes.slice(lo, 16384)
            parts = np.stack(self.coarse.route(some, universe, max(beam, probes)))
            rows, pos, _ = S.decode(some, universe)
            dense = np.zeros((len(some), universe), np.float32)
            dense[rows, pos] = 1
            score = np.empty((*parts.shape, self.pieces), np.float32)
            order = np.argsort(parts, axis=None, kind="stable")
            chosen, first = np.unique(parts.ravel()[order], return_index=True)
            for part, at in zip(chosen, np.split(order, first[1:])):
                at = np.unravel_index(at, parts.shape)
                score[at] = dense[at[0]] @ (self.weight[part].astype(np.float32) / 8) + self.bias[part]
            score, cell = -score.reshape(len(some), -1), (parts[:, :, None] * self.pieces + np.arange(self.pieces)).reshape(len(some), -1)
            k = min(probes, score.shape[1])
            top = np.argpartition(score, k - 1, axis=1)[:, :k]
            out += list(np.take_along_axis(cell, np.take_along_axis(top, np.argsort(np.take_along_axis(score, top, 1), axis=1), 1), 1))
        return out


def near_graph(sample: list[bytes], universe: int, degree: int) -> np.ndarray:
    """``sample_graph`` of a small sample, where it stands."""
    rows, pos, n = S.decode(pa.array(sample, pa.binary()), universe)
    unit = np.zeros((len(n), universe), np.float32)
    unit[rows, pos] = 1 / np.sqrt(n[rows])
    similarity = unit @ unit.T
    np.fill_diagonal(similarity, -1)
    k = min(degree, len(sample) - 1)
    return np.argpartition(-similarity, k - 1, axis=1)[:, :k]


def split(coarse: Router, distinct: DataFrame, n_sets: int, pieces: int, universe: int, degree: int) -> SplitRouter:
    """``coarse`` with each part cut into ``pieces``, on the executors, part by part.

    About ``PIECE_ROWS`` vectors for each piece are picked by hash. Those for which a part is the first or second choice teach its pieces, as the parts
    were learned; then all are fitted once more on the vectors whose first choice they are among the pieces of all parts, since a vector's best piece
    may lie across the border of its part.
    """
    spark, parts = distinct.sparkSession, len(coarse.bias)
    share = min(1.0, PIECE_ROWS * pieces * parts / n_sets)
    picked = distinct.where(F.pmod(F.xxhash64("code", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("code")
    most = 4 * PIECE_ROWS * pieces  # vectors that one part's pieces are learned from

    def shared_out(router, choices: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(router)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = np.stack(shared.value.route(b.column(0), universe, choices)) if b.num_rows else np.empty((0, choices), np.int64)
                row = np.repeat(np.arange(len(cells)), cells.shape[1])
                part, piece = np.divmod(cells.ravel(), pieces) if choices == 1 else (cells.ravel(), np.zeros(cells.size, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(piece.astype(np.int32)), b.column(0).take(pa.array(row))], ["part", "piece", "code"])

        return picked.mapInArrow(run, "part int, piece int, code binary")

    def fitted(rows: DataFrame, learn: bool) -> SplitRouter:
        def run(table: pa.Table) -> pa.Table:
            codes, label = table["code"].to_pylist(), table["piece"].to_numpy().astype(np.int64)
            if learn:
                codes = sorted(set(codes), key=hashed)[:most]
                sample = codes[: min(SAMPLE_ROWS, PIECE_ROWS // 2 * pieces)]
                if len(sample) <= 2 * pieces:
                    label = np.zeros(len(codes), np.int64)
                else:
                    first = Router.of_sample(sample, balanced_parts(near_graph(sample, universe, degree), pieces), pieces, universe)
                    label = np.array([x[0] for x in first.route(pa.array(codes, pa.binary()), universe, 1)], np.int64)
            router = Router.of_sample(codes, label, pieces, universe)
            weight = np.clip(np.round(router.weight * 8), -127, 127).astype(np.int8)
            bias = np.where(np.bincount(label, minlength=pieces) > 0, router.bias, -1e6).astype("<f4")  # an empty piece is nobody's choice
            return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "weight": pa.array([weight.tobytes()], pa.binary()), "bias": pa.array([bias.tobytes()], pa.binary())})

        weight, bias = np.zeros((parts, universe, pieces), np.int8), np.full((parts, pieces), -1e6, np.float32)
        for r in rows.groupBy("part").applyInArrow(run, "part int, weight binary, bias binary").collect():  # one row of universe x pieces bytes a part, 134 MB at most
            weight[r["part"]] = np.frombuffer(bytes(r["weight"]), np.int8).reshape(universe, pieces)
            bias[r["part"]] = np.frombuffer(bytes(r["bias"]), "<f4")
        return SplitRouter(coarse, weight, bias)

    return fitted(shared_out(fitted(shared_out(coarse, min(2, parts)), True), 1), False)


def hashed(code: bytes) -> bytes:
    return hashlib.blake2b(code, digest_size=8).digest()


def fit_router(distinct: DataFrame, n_sets: int, *, universe: int, rows_per_part: int = 1000, most_parts: int = 1024, degree: int = 10) -> Router | SplitRouter:
    sample = S.sample_codes(distinct, SAMPLE_ROWS, seed=1)
    wanted = max(16, 1 << max(0, round(np.log2(max(1, n_sets / rows_per_part)))))
    parts = min(wanted, most_parts)
    if len(sample) <= parts * 2:
        return Router.of_sample(sample or [b"\0" * (2 * -(-universe // 256))], np.zeros(max(1, len(sample)), int), 1, universe)
    near = sample_graph(sample, universe, degree, distinct.sparkSession)
    first = Router.of_sample(sample, balanced_parts(near, parts), parts, universe)
    coarse = first if n_sets <= SAMPLE_ROWS else refitted(first, distinct, n_sets, universe)
    return coarse if wanted <= parts else split(coarse, distinct, n_sets, min(MOST_SPLIT, wanted // parts), universe, degree)


def nearest(pairs: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Of pairs in both directions those (``a``, ``b``, ``sim``) where fewer than ``k`` rows are more similar to a row of ``a``; ties stay.

    ``copies`` has (``rep``, ``copies``) of sets that stand in several rows: a row's own copies are its most similar rows.
    """
    some = S.small(copies)
    own, theirs = some.select(F.col("rep").alias("a"), F.col("copies").alias("ca")), some.select(F.col("rep").alias("b"), F.col("copies").alias("cb"))
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), S.rounded_cosine().alias("sim"))
    scored = pairs.select("a", "b", S.rounded_cosine().alias("sim")).unionByName(flipped).join(own, "a", "left").join(theirs, "b", "left")
    # all windows divide by the same column, so the pairs are shuffled once
    rows = F.coalesce("cb", F.lit(1))
    by_sim = Window.partitionBy("a").orderBy(F.desc("sim")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    nearer = F.sum(rows).over(by_sim) - F.sum(rows).over(Window.partitionBy("a", "sim")) + F.coalesce("ca", F.lit(1)) - 1
    return scored.withColumn("nearer", nearer).where(F.col("nearer") < k).select("a", "b", "sim")


def nearest_rows(
    records: DataFrame, *, key: str = "row_id", column: str = "bf_indices", a: str = "row_a", b: str = "row_b", k: int = 5, least: float = 0.6,
    universe: int = 1024, homes: int = 2, probes: int = 7, block_rows: int = 32768, most_parts: int = 1024,
) -> DataFrame:
    """Pairs of rows (``a`` < ``b``) with ``similarity`` (cosine, six decimals, at least ``least``) where one is among the ``k`` most
    similar of the other; all rows that tie with the k-th count. Each pair once.

    The cosine is computed from the sets, so stored norms (null, NaN, rounded or out of date) play no part. Null and empty sets
    are in no pair. Equal sets are one vector until the end, then all their rows count. Extra columns are
    ignored; an empty table gives no pairs.
    """
    spark = records.sparkSession
    encoded = S.encoded_sets(records, key, column, universe).persist()
    distinct = S.distinct_sets(encoded).persist()
    fitted = fit_router(distinct, distinct.count(), universe=universe, most_parts=most_parts)
    router = spark.sparkContext.broadcast(fitted)  # universe x most_parts weights
    assigned = S.map_codes(distinct, lambda codes: router.value.route(codes, universe, probes)).persist()
    rule = S.Rule("cosine", least)
    chunk = min(200_000, max(40_000, 20 * fitted.cells))  # of more cells more records are packed at once, else the packages are small
    near = checkpointed(S.routed_pairs(assigned, fitted.cells, homes, rule, universe=universe, block_rows=block_rows, chunk=chunk).distinct())
    assigned.unpersist()
    del assigned
    release(spark)
    pairs = checkpointed(S.verified(near, distinct, rule, universe))
    release(spark)
    members = checkpointed(S.copy_rows(encoded, distinct))
    kept = nearest(pairs, S.copy_counts(members), k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()
    links = S.expanded(kept, S.small(members), a, b, "sim").unionByName(S.copy_pairs(members, a, b).withColumn("sim", F.lit(1.0)))
    return links.select(a, b, F.col("sim").alias("similarity")).distinct()


def repaired_norms(records: DataFrame, *, column: str = "bf_indices", norm: str = "bf_norms", digits: int = 6) -> DataFrame:
    """``records`` with ``norm`` set to the square root of the number of distinct positions where it is null, NaN or off by more
    than ``10**-digits``, and ``norm_repaired``. A null or empty set has norm 0."""
    true = F.sqrt(F.size(F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<int>")))).cast("double"))
    off = F.col(norm).isNull() | F.isnan(norm) | (F.abs(F.col(norm) - true) > 10.0**-digits)
    return records.withColumn("norm_repaired", F.coalesce(off, F.lit(True))).withColumn(norm, F.when(F.col("norm_repaired"), true).otherwise(F.col(norm)))

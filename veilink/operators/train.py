"""Training the soft-cosine matrix from aligned records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embed import Embedded, Embedder


def joint_frequencies(pairs: DataFrame, prob: bool = False) -> DataFrame:
    """(``i``, ``j``, ``count``) of (``x``, ``y``) index lists of aligned rows: how often i stands left and j right, made symmetric.

    Null and empty lists add nothing; with ``prob`` counts are divided by the number of rows.
    """
    n = pairs.count() if prob else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                x, y = (_flat(b.column(c).slice(lo, 1024)) for c in (0, 1))
                width = max(len(total), *(int(v.max(initial=-1)) + 1 for _, v in (x, y)))
                if width > len(total):
                    total = np.pad(total, (0, width - len(total)))
                left, right = np.zeros((1024, width), np.float32), np.zeros((1024, width), np.float32)
                left[x], right[y] = 1, 1
                total += left.T @ right
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    # each partition multiplies its 0/1 matrices; only the cells of the products, at most width squared each, are shuffled
    cells = pairs.select(F.col("x").cast("array<int>"), F.col("y").cast("array<int>")).mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = cells.select(F.explode(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n"))).alias("c")).select("c.*")
    return both.groupBy("i", "j").agg((F.sum("n") / (2 * max(1, n))).alias("count"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values that aren't null."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    rows, values = np.repeat(np.arange(len(lists)), sizes), lists.flatten()
    known = np.asarray(values.is_valid())
    return rows[known], np.asarray(values.drop_null()).astype(np.int64)


def to_matrix(cells: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    rows = cells.toPandas()  # at most width squared
    out[rows["i"], rows["j"]] = rows["count"]
    return out


def nearest_positive(x: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """The symmetric part of ``x`` with negative eigenvalues set to ``eps``."""
    values, vectors = np.linalg.eigh((x + x.T) / 2)
    return (vectors * np.where(values < 0, eps, values)) @ vectors.T


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """(``x``, ``y``) with the right lists dealt to other rows at random."""
    from .link import dense_ranks

    left = dense_ranks(df.select("x"), "r")
    right = dense_ranks(df.select("y", F.rand(seed).alias("o")).orderBy("o").drop("o"), "r")
    return left.join(right, "r").select("x", "y")


def train(embedder: Embedder, left: Embedded, right: Embedded, on: tuple[str, str], update: bool = True, learning_rate: float = 1.0, eps: float = 0.01, seed: int = 0) -> Embedder:
    """An embedder trained on rows of both tables that agree on the id columns ``on``.

    Matched counts come from aligned rows, unmatched from shuffled ones. They are added, ``learning_rate`` times, to those so far, or
    without ``update`` to the identity. The checksum changes with the matrix.
    """
    embedder.check(left, right)
    if eps < 0 or not 0 < learning_rate <= 1:
        raise ValueError("eps must not be negative, learning_rate must lie in (0, 1]")
    aligned = left.df.select(F.col(on[0]).alias("k"), F.col("bf_indices").alias("x")).join(right.df.select(F.col(on[1]).alias("k"), F.col("bf_indices").alias("y")), "k").select("x", "y").persist()
    width = embedder.width
    matched, unmatched = (to_matrix(joint_frequencies(p), width) for p in (aligned, shuffled(aligned, seed)))
    kept = (embedder.matched, embedder.unmatched) if update else (None, None)
    matched, unmatched = ((np.eye(width) if k is None else k) + learning_rate * new for k, new in zip(kept, (matched, unmatched)))
    aligned.unpersist()
    ratio = np.log(matched + eps) - np.log(unmatched + eps)
    return Embedder(embedder.bloom, embedder.options, embedder.factory, nearest_positive(ratio, 1e-6).astype(np.float32), matched.astype(np.float32), unmatched.astype(np.float32))

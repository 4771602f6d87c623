"""All pairs of sets whose Jaccard similarity reaches a threshold.

Distinct sets meet in the cells of their segments (``sets.Segments``), which lose no pair, whatever the data, and are compared exactly.

Cells of pivots, which are records, can't do this. A partner within ``r`` of a record at ``d`` from its nearest
pivot may have any pivot within ``d + 2r`` as its own nearest. On sets over a small universe nearly all distances
lie close to one, and with ``r = 0.3`` this bound names every cell for nearly every record (``bound_replication``
measures it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, release
from . import sets as S


def pivot_counts(rows: np.ndarray, pos: np.ndarray, n_rows: int, table: np.ndarray) -> np.ndarray:
    """Intersections of each set with all pivots: sums of the pivots' rows, one row of ``table`` for a position."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    out = np.empty((n_rows, table.shape[1]), table.dtype)
    for i in range(n_rows):
        np.add.reduce(table[pos[bounds[i] : bounds[i + 1]]], axis=0, dtype=table.dtype, out=out[i])
    return out


def similarities(codes: pa.BinaryArray, pivots: list[bytes], universe: int) -> np.ndarray:
    """Jaccard similarity of every set with every pivot."""
    table, pivot_sizes = _table(tuple(pivots), universe)
    rows, pos, n = S.decode(codes, universe)
    o = pivot_counts(rows, pos, len(codes), table).astype(np.float32)
    return o / (n[:, None].astype(np.float32) + pivot_sizes[None, :] - o)


_TABLES: dict = {}


def _table(pivots: tuple[bytes, ...], universe: int) -> tuple[np.ndarray, np.ndarray]:
    if (key := hash((pivots, universe))) not in _TABLES:
        rows, pos, n = S.decode(pa.array(pivots, pa.binary()), universe)
        table = np.zeros((universe, len(pivots)), np.uint8 if n.max(initial=0) < 256 else np.uint16)
        table[pos, rows] = 1
        _TABLES.clear()
        _TABLES[key] = table, n.astype(np.float32)
    return _TABLES[key]


def n_cells(sets: int, rows_per_cell: int, most: int) -> int:
    return int(min(most, max(16, 1 << max(0, round(np.log2(max(1, sets / rows_per_cell)))))))


def similar_sets(
    records: DataFrame, *, key: str = "row_id", column: str = "bf_indices", threshold: float = 0.7, universe: int = 1024,
    replicas: int = 10, rows_per_cell: int = 2000, most_pivots: int = 1024, block_rows: int = 32768,
) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives ``a``, ``b`` with ``o``, ``na``, ``nb``; members ``rep``, ``row`` of sets in several rows).

    Equal sets are one record until the end, so any number of copies costs nothing. Null and empty sets are in no pair;
    repeated and unsorted positions don't matter. Two rows of one key count once if their sets are equal. Ties at the threshold
    count. Extra columns are ignored; an empty table gives no pairs. ``rows_per_cell`` and ``most_pivots`` give the size of the sample from which the shares
    of contents are estimated; ``replicas`` is accepted and changes nothing, as no set goes to cells of pivots.
    """
    encoded = S.encoded_sets(records, key, column, universe).persist()
    distinct = S.distinct_sets(encoded).persist()
    n_sets = distinct.count()
    sample = S.sample_codes(distinct, n_cells(n_sets, rows_per_cell, most_pivots))
    rule = S.Rule("jaccard", threshold)
    heads = 2 * -(-universe // 256)  # bytes of a code besides its positions
    largest = (distinct.agg(F.max(F.length("code"))).first()[0] or heads) - heads
    shared = records.sparkSession.sparkContext.broadcast(S.Segments(rule, sample, largest, universe, n_sets))
    sketched = S.map_sketches(distinct, lambda codes: shared.value.prefixes(codes), universe).persist()
    near = checkpointed(S.sketch_pairs(sketched, rule, block_rows=block_rows))
    sketched.unpersist()
    release(records.sparkSession)
    return checkpointed(S.verified(near, distinct, rule, universe)), checkpointed(S.copy_rows(encoded, distinct))


def similar_rows(records: DataFrame, *, key: str = "row_id", a: str = "row_a", b: str = "row_b", **options) -> DataFrame:
    """All pairs of rows (``a`` < ``b``) whose sets reach the threshold, copies included, each once."""
    pairs, members = similar_sets(records, key=key, **options)
    return S.expanded(pairs, S.small(members), a, b).unionByName(S.copy_pairs(members, a, b)).distinct()


def similar_row_links(records: DataFrame, *, key: str = "row_id", **options) -> DataFrame:
    """One row for each record with a set: its ``class_id`` (smallest row of equal set), ``copies`` and ``links``, its number of partners."""
    column, universe = options.get("column", "bf_indices"), options.get("universe", 1024)
    pairs, members = similar_sets(records, key=key, **options)
    encoded = S.encoded_sets(records, key, column, universe)
    classes = S.distinct_sets(encoded)
    copies = S.copy_counts(members)
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    one = F.coalesce("copies", F.lit(1))
    links = both.join(copies.withColumnRenamed("rep", "y"), "y", "left").groupBy(F.col("x").alias("rep")).agg(F.sum(one).alias("others"))
    rows = encoded.join(classes.select("code", "rep"), "code").join(copies, "rep", "left").join(links, "rep", "left").withColumn("copies", one)
    return rows.select(F.col("row").alias(key), F.col("rep").alias("class_id"), "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")).distinct()


def bound_replication(records: DataFrame, *, key: str = "row_id", column: str = "bf_indices", threshold: float = 0.7, universe: int = 1024, pivots: int = 1024) -> DataFrame:
    """Mean share of all cells to which the plain triangle bound would send a record."""
    distinct = S.distinct_sets(S.encoded_sets(records, key, column, universe))
    chosen = S.sample_codes(distinct, pivots)
    shared = records.sparkSession.sparkContext.broadcast(chosen)

    def route(codes: pa.BinaryArray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo in range(0, len(codes), 512):
            s = similarities(codes.slice(lo, 512), shared.value, universe)
            out += list((s >= s.max(axis=1, keepdims=True) - 2 * (1 - threshold)).sum(1)[:, None])
        return out

    n = max(1, len(chosen))
    return S.map_codes(distinct, route).agg(F.round(F.avg(F.col("cells")[0] / n), 4).alias("share_of_cells"), F.count("*").alias("sets"))

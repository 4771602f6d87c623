"""Embedding a stream of records: the same expressions as for tables, without state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import Embedded, Embedder


def embed_stream(stream: DataFrame, embedder: Embedder, colspec: Mapping[str, str], id_column: str, keep: list[str] | None = None) -> DataFrame:
    """Anonymised filters with norms of each record as it arrives; thresholds need a whole table and aren't part of a stream."""
    return embedder.embed(stream, colspec, id_column, update_norms=True).anonymise([id_column, *(keep or [])])


def write_stream(embedded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until the source has been read up."""
    return embedded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_static_matches(stream: DataFrame, reference: Embedded, least: float) -> DataFrame:
    """(``id1``, ``id2``, ``sim``) of streamed filters (``id``, ``bf_indices``) against a table, by an inverted index of the table's positions.

    Both sides are exploded, so no record is sent to all tasks; a streamed id that comes twice within a batch counts once.
    """
    table = reference.df.select(F.col(reference.id_column).alias("id2"), F.array_distinct("bf_indices").alias("x")).select("id2", F.size("x").alias("n2"), F.explode("x").alias("pos"))
    arrived = stream.select(F.col("id").alias("id1"), F.array_distinct("bf_indices").alias("x")).select("id1", F.size("x").alias("n1"), F.explode("x").alias("pos"))
    counts = arrived.join(table, "pos").groupBy("id1", "id2", "n1", "n2").agg(F.countDistinct("pos").alias("o")) if not stream.isStreaming else None
    if counts is None:
        raise ValueError("call this inside foreachBatch, on the batch's table")
    return counts.select("id1", "id2", (F.col("o") / F.sqrt(F.col("n1") * F.col("n2"))).alias("sim")).where(F.col("sim") >= least)

"""Session helpers: reliable checkpoints, spreading of badly split inputs, table reads."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a temporary folder is used only where that
    setting is absent and everything runs on one machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``; where ``df`` was made so itself (``packed`` ends so too), both functions run in one worker. Otherwise each function of
    a row of them takes a process of its own for each task slot, and idle ones stay for the next stages."""
    source, before = df.__dict__.get("_mapped", (df, None))
    whole = run if before is None else lambda batches: run(before(batches))
    out = source.mapInArrow(whole, schema)
    out._mapped = source, whole
    return out


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint of compressed batches: a checkpoint of plain rows takes eight bytes and more a value on disk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_buffer())

    return mapped(checkpointed(mapped(df, pack, "batch binary")), unpack, df.schema)


def release(spark: SparkSession) -> None:
    """Let the files of shuffles go that nothing refers to any more. Spark deletes them when the driver's JVM collects garbage, which it does seldom by
    itself; this asks for it, so that a query of several steps doesn't hold the shuffles of all of them on disk at once. Python's objects
    give up what they hold in the JVM by a thread that looks once a second, hence the wait."""
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master, an error on a cluster without the setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="veilink-")


def slots(spark: SparkSession) -> int:
    """Task slots of the running application."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle that is placed by hand: the session's own setting, at least one per task slot."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots(spark))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all task slots where its files are split into fewer than half as many partitions."""
    n = slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() * 2 >= n else df.repartition(n)

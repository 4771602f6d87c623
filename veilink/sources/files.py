"""Small files by path or by any URI that Hadoop knows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def _hadoop(uri: str):
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return spark._jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:/")


def exists(path: str) -> bool:
    if not is_uri(path):
        return Path(path).exists()
    _, at, fs = _hadoop(path)
    return fs.exists(at)


def read_file(path: str) -> bytes:
    """The bytes of a file that fits the driver, such as a configuration or a key."""
    if not is_uri(path):
        return Path(path).read_bytes()
    jvm, at, fs = _hadoop(path)
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_file(path: str, data: bytes) -> None:
    if not is_uri(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(data)
        return
    _, at, fs = _hadoop(path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def parts_of(folder: str) -> Iterator[str]:
    """Data files of a folder that Spark wrote, in order."""
    if not is_uri(folder):
        yield from sorted(str(p) for p in Path(folder).glob("part-*"))
        return
    _, at, fs = _hadoop(folder)
    yield from sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))


def write_zip(target: str, members: dict[str, list[str]]) -> None:
    """A ZIP file on the driver's disk: each member is the contents of its files one after the other, one file in memory at a time."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, files in members.items():
            with z.open(name, "w", force_zip64=True) as out:
                for f in files:
                    out.write(read_file(f))

"""Salted SHA-256 Bloom filters of feature lists.

Index of feature ``g`` under hash ``i``: the digest of ``g + i + salt``, read as a little-endian number, modulo the size. For a
size that is a power of two up to 65,536 only the first two digest bytes matter. All of it is built-in functions, but for ``with_indices``,
which makes the digests of a whole column in Arrow batches, once for each distinct feature of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType


@dataclass(frozen=True)
class BloomFilter:
    size: int = 1024
    num_hashes: int = 2
    offset: int = 0
    salt: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.size < 1 << 31 or self.num_hashes < 0:
            raise ValueError("size must be positive and below 2^31, num_hashes not negative")

    def raw(self, features: Column) -> Column:
        """Index of every feature under every hash, with repeats; null features give none."""
        features = F.coalesce(features, F.array().cast("array<string>"))
        of = self._low_bytes if self.size <= 65536 and self.size & (self.size - 1) == 0 else self._whole_digest

        def one(g: Column, i: int) -> Column:
            digest = F.sha2(F.concat(g, F.lit(f"{i}{self.salt or ''}")).cast("binary"), 256)
            return (of(digest) + self.offset).cast("int")

        hashes = [lambda g, i=i: one(g, i) for i in range(self.num_hashes)]
        if not hashes:
            return F.array().cast("array<int>")
        return F.flatten(F.transform(features, lambda g: F.array(*[h(g) for h in hashes]))).cast("array<int>")

    def _low_bytes(self, digest: Column) -> Column:
        return F.conv(F.concat(F.substring(digest, 3, 2), F.substring(digest, 1, 2)), 16, 10).cast("int") % self.size

    def _whole_digest(self, digest: Column) -> Column:
        """The digest's remainder for any size: its bytes last to first, in pieces of 14 digits, each times the remainder of its place value."""
        ordered = F.reverse(F.regexp_replace(digest, "(.)(.)", "$2$1"))
        total = F.lit(0).cast("bigint")
        for start in range(0, 64, 14):
            digits = min(14, 64 - start)
            piece = F.conv(F.substring(ordered, start + 1, digits), 16, 10).cast("bigint") % self.size
            total = (total + piece * pow(16, 64 - start - digits, self.size)) % self.size
        return total

    def indices(self, features: Column) -> Column:
        """Sorted distinct indices."""
        return F.sort_array(F.array_distinct(self.raw(F.array_distinct(F.coalesce(features, F.array().cast("array<string>"))))))

    def with_indices(self, df: DataFrame, features: Column, name: str) -> DataFrame:
        """``df`` with the ``indices`` of ``features`` under ``name``. For any size but a power of two this is far faster than the expression, which
        takes the remainder of a digest piece by piece; it isn't a column function, as Spark doesn't run one in Python on nested lambdas."""
        if name in df.columns:
            raise ValueError(f"column {name} exists already")
        size, offset, hashes = self.size, self.offset, self.num_hashes
        ends = [f"{i}{self.salt or ''}".encode() for i in range(hashes)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(b.num_columns - 1)
                coded = lists.flatten().cast(pa.binary()).dictionary_encode()
                table = np.array([int.from_bytes(hashlib.sha256(g + e).digest(), "little") % size + offset for g in coded.dictionary.to_pylist() for e in ends], np.int64)
                known = np.asarray(coded.indices.is_valid())
                row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))[known]
                index = table.reshape(len(coded.dictionary), hashes)[np.asarray(coded.indices.drop_null())]
                # sorted and distinct in each row
                pairs = np.unique(np.repeat(row, hashes) << 32 | index.ravel())
                starts = np.searchsorted(pairs >> 32, np.arange(b.num_rows + 1))
                made = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs & 0xFFFFFFFF).cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], name])

        given = df.withColumn(name, F.coalesce(features, F.array().cast("array<string>")))
        schema = StructType([*given.schema.fields[:-1]]).add(name, ArrayType(IntegerType()))
        return given.mapInArrow(run, schema)

    def collision_fraction(self, features: Column) -> Column:
        """One less the share of distinct indices; 0 where there are no features."""
        raw = self.raw(features)
        return F.when(F.size(raw) > 0, 1 - F.size(F.array_distinct(raw)) / F.size(raw)).otherwise(F.lit(0.0))

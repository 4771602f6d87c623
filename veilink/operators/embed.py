"""Embedding party tables: features, Bloom filters, norms, thresholds, projection; saving and loading the configuration."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import BloomFilter
from ..functions.features import FACTORY, Feature, no_features
from ..sources.files import exists, read_file, write_file


def _function_digest(f: Callable) -> str:
    """The name of a built-in feature function; of another one a digest of its code, constants and defaults."""
    if f in FACTORY.values():
        return f.__name__
    code = getattr(f, "__code__", None)
    if code is None:  # a callable object or a partial function
        inner = getattr(f, "func", None) or getattr(type(f), "__call__")
        return hashlib.sha256(repr((_function_digest(inner) if hasattr(inner, "__code__") else repr(inner), getattr(f, "args", ()), getattr(f, "keywords", {}))).encode()).hexdigest()

    def parts(c) -> tuple:
        return c.co_code, c.co_names, tuple(parts(x) if hasattr(x, "co_code") else x for x in c.co_consts)

    return hashlib.sha256(repr((parts(code), f.__defaults__, f.__kwdefaults__)).encode()).hexdigest()


@dataclass(frozen=True)
class Embedded:
    """A table with ``bf_indices`` (and, where computed, ``bf_norms`` and ``thresholds``) and the checksum of what made it."""

    df: DataFrame
    checksum: str
    id_column: str

    @classmethod
    def from_df(cls, df: DataFrame, embedder: "Embedder", id_column: str, update_norms: bool = True, update_thresholds: bool = False) -> "Embedded":
        """Wrap a table read back from a file; ``bf_indices`` is the only column it must have besides the id."""
        for c in ("bf_indices", id_column):
            if c not in df.columns:
                raise ValueError(f"column {c} is missing")
        made = cls(df, embedder.checksum, id_column)
        if update_norms:
            made = embedder.with_norms(made)
        return embedder.with_thresholds(made) if update_thresholds else made

    def anonymise(self, keep: list[str] | None = None) -> DataFrame:
        """Only ``keep``, ``bf_indices``, ``bf_norms`` and ``thresholds``, in the table's own order."""
        wanted = {*(keep or []), "bf_indices", "bf_norms", "thresholds"}
        return self.df.select(*[c for c in dict.fromkeys(self.df.columns) if c in wanted])


@dataclass
class Embedder:
    """Configuration of an embedding: column types with their arguments, the Bloom filter, and the trained matrices.

    ``factory`` maps a column type to a maker of features (``FACTORY`` by default); user functions ``Column -> Column`` may be
    registered as ``lambda **options: function``. ``scm`` is the soft-cosine matrix, None for the identity.
    """

    bloom: BloomFilter = field(default_factory=BloomFilter)
    options: Mapping[str, dict] = field(default_factory=dict)
    factory: Mapping[str, Callable[..., Feature]] = field(default_factory=lambda: dict(FACTORY))
    scm: np.ndarray | None = None
    matched: np.ndarray | None = None
    unmatched: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.bloom.size + self.bloom.offset

    @property
    def checksum(self) -> str:
        """Digest of column types with their functions, their options, the filter's shape and every byte of the matrix; the salt is no part of it.

        A function of one's own counts by its compiled code, so parties that share one need the same version of Python.
        """
        text = json.dumps([[[k, _function_digest(f)] for k, f in sorted(self.factory.items())], {k: repr(sorted(v.items())) for k, v in sorted(self.options.items())}, self.bloom.size, self.bloom.num_hashes, self.bloom.offset])
        digest = hashlib.md5(text.encode(), usedforsecurity=False)
        if self.scm is not None:
            digest.update(np.ascontiguousarray(self.scm, np.float32).tobytes())
        return digest.hexdigest()

    def feature(self, column: str, kind: str) -> Column:
        if kind not in self.factory:
            raise ValueError(f"no feature function for column type {kind!r}")
        options = dict(self.options.get(kind, {}))
        if self.factory[kind] in (FACTORY["misc"], FACTORY["shingled"]):
            options.setdefault("label", column)
        return F.coalesce(self.factory[kind](**options)(F.col(f"`{column}`")), no_features())

    def embed(self, df: DataFrame, colspec: Mapping[str, str], id_column: str, update_norms: bool = True, update_thresholds: bool = False) -> Embedded:
        """``id_column``, the columns of ``colspec``, their ``<column>_features``, ``all_features``, ``bf_indices`` and, as
        asked, ``bf_norms`` and ``thresholds``.

        A row without features has an empty filter, norm 0 and similarity 0 to all. Other columns of ``df`` are dropped;
        repeated rows stay. Narrow: no row is shuffled before thresholds.
        """
        missing = [c for c in (*colspec, id_column) if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the table: {missing}")
        base = list(dict.fromkeys([id_column, *colspec]))
        out = df.select(*[f"`{c}`" for c in base], *[self.feature(c, k).alias(f"{c}_features") for c, k in colspec.items()])
        bags = [F.col(f"`{c}_features`") for c in colspec]
        out = out.withColumn("all_features", F.array_distinct(F.concat(*bags)) if bags else no_features())
        out = out.withColumn("bf_indices", self.bloom.indices(F.col("all_features")))
        return Embedded.from_df(out, self, id_column, update_norms, update_thresholds)

    def with_norms(self, edf: Embedded) -> Embedded:
        """``bf_norms``: root of the sum of the matrix over a record's own indices."""
        self.check(edf)
        if self.scm is None:
            norm = F.sqrt(F.size(F.array_distinct(F.coalesce("bf_indices", F.array().cast("array<int>")))).cast("double"))
        else:
            shared = edf.df.sparkSession.sparkContext.broadcast(self.scm)  # width x width

            @F.pandas_udf("double")
            def trained(lists: pd.Series) -> pd.Series:
                a = shared.value.astype(np.float64)
                sets = (np.unique(x) if x is not None else () for x in lists)  # an index listed twice counts once
                return pd.Series([float(np.sqrt(max(0.0, a[np.ix_(x, x)].sum()))) if len(x) else 0.0 for x in sets])

            norm = trained("bf_indices")
        return Embedded(edf.df.withColumn("bf_norms", norm), edf.checksum, edf.id_column)

    def with_thresholds(self, edf: Embedded, **options) -> Embedded:
        from .similarity import self_thresholds

        return self_thresholds(self, edf, **options)

    def check(self, *edfs: Embedded) -> None:
        if any(e.checksum != self.checksum for e in edfs):
            raise ValueError("the table was made by another embedder")

    def save(self, folder: str) -> None:
        """JSON configuration and matrices, under a path or a URI; no code and no salt goes into the folder."""
        config = {"size": self.bloom.size, "num_hashes": self.bloom.num_hashes, "offset": self.bloom.offset, "options": self.options, "types": sorted(self.factory), "checksum": self.checksum}
        write_file(f"{folder}/embedder.json", json.dumps(config, indent=1).encode())
        for name in ("scm", "matched", "unmatched"):
            if (m := getattr(self, name)) is not None:
                out = io.BytesIO()
                np.save(out, m)
                write_file(f"{folder}/{name}.npy", out.getvalue())

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        config = {"size": self.bloom.size, "num_hashes": self.bloom.num_hashes, "offset": self.bloom.offset, "options": self.options, "checksum": self.checksum}
        matrices = {n: m for n in ("scm", "matched", "unmatched") if (m := getattr(self, n)) is not None}
        np.savez_compressed(out, config=np.array(json.dumps(config)), **matrices)
        return out.getvalue()

    @classmethod
    def load(cls, path: str | None = None, data: bytes | None = None, salt: str | None = None, factory: Mapping | None = None) -> "Embedder":
        """From a folder (a path or a URI) or from bytes, exactly one of them; the stored checksum must be that of what is read."""
        if (path is None) == (data is None):
            raise ValueError("give either a path or bytes")
        if data is not None:
            with np.load(io.BytesIO(data), allow_pickle=False) as z:
                config, matrices = json.loads(str(z["config"])), {n: z[n] for n in ("scm", "matched", "unmatched") if n in z}
        else:
            config = json.loads(read_file(f"{path}/embedder.json"))
            matrices = {n: np.load(io.BytesIO(read_file(f)), allow_pickle=False) for n in ("scm", "matched", "unmatched") if exists(f := f"{path}/{n}.npy")}
        bloom = BloomFilter(config["size"], config["num_hashes"], config["offset"], salt)
        made = cls(bloom, config["options"], dict(factory or FACTORY), **matrices)
        if made.checksum != config["checksum"]:
            raise ValueError("the stored checksum isn't that of the configuration")
        return made


def party_to_filters(df: DataFrame, colspec: Mapping[str, str], id_column: str, other_columns: list[str] | None = None, salt: str = "") -> DataFrame:
    """One call from a party's table to what it may share: names as 1- to 4-grams with skip-grams, norms and thresholds, anonymised.

    Column types are ``name``, ``dob``, ``sex``, ``misc_features`` and ``misc_shingled_features``; ``misc`` and ``shingled`` are short for the last two.
    """
    types = FACTORY | {"misc_features": FACTORY["misc"], "misc_shingled_features": FACTORY["shingled"]}
    embedder = Embedder(BloomFilter(salt=salt), {"name": {"ngram_length": [1, 2, 3, 4], "use_gen_skip_grams": True}}, types)
    keep = list(other_columns if other_columns is not None else [id_column])
    made = embedder.embed(df, colspec, id_column, update_norms=True, update_thresholds=True)
    extra = [c for c in keep if c not in made.df.columns and c in df.columns]
    if extra:
        joined = made.df.join(df.select(id_column, *extra).dropDuplicates([id_column]), id_column)
        made = Embedded(joined, made.checksum, id_column)
    return made.anonymise(keep)

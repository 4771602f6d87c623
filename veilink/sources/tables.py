"""Reading party tables, writing results, and where the files of parties stand."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crypto import KeyProvider, decrypt_table, encrypt_table
from ..operators.embed import Embedded, Embedder
from .files import exists, parts_of, read_file, write_file, write_zip


def is_csv(path: str) -> bool:
    """Whether a file name has a stem and ends in ``.csv``, in any case."""
    stem, dot, ending = os.path.basename(path or "").rpartition(".")
    return bool(stem and dot) and ending.lower() == "csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, nulls as empty strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.fillna("", subset=df.columns)


def read_party(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A party's table: CSV, JSON or Parquet, by ``kind`` or the ending of ``path``."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return spark.read.json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {kind}")


def write_party(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":  # lists as JSON text
        df = df.selectExpr(*[f"to_json(`{c}`) AS `{c}`" if t.startswith("array") else f"`{c}`" for c, t in df.dtypes])
        df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind in ("json", "parquet"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")


def read_embedded(spark: SparkSession, path: str, embedder: Embedder, id_column: str, **options) -> Embedded:
    """A table of filters read back, tied to its embedder again."""
    return Embedded.from_df(read_party(spark, path), embedder, id_column, **options)


def export_bundle(edf: Embedded, embedder: Embedder, folder: str, keep: list[str] | None = None, archive: str | None = None) -> None:
    """What a party may share, under one folder: ``data`` (CSV: the id column, ``keep``, filters, norms and thresholds; no other column) and ``embedder``.

    With ``archive`` also as one ZIP file of ``data.csv`` and the embedder's files.
    """
    write_party(edf.anonymise([edf.id_column, *(keep or [])]), f"{folder}/data", "csv")
    embedder.save(f"{folder}/embedder")
    if archive is not None:
        spark = edf.df.sparkSession
        one = f"{folder}/data-one"  # a single file, so that it has a single header
        spark.read.csv(f"{folder}/data", header=True, multiLine=True, escape='"').coalesce(1).write.mode("overwrite").csv(one, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        names = [n for n in ("embedder.json", "scm.npy", "matched.npy", "unmatched.npy") if exists(f"{folder}/embedder/{n}")]
        write_zip(archive, {"data.csv": list(parts_of(one)), **{f"embedder/{n}": [f"{folder}/embedder/{n}"] for n in names}})


def read_encrypted(spark: SparkSession, folder: str, party: str, schema: str, provider: KeyProvider) -> tuple[DataFrame, bytes]:
    """A party's decrypted table, and its data key: ``<party>-data.json`` holds the rows' payloads, ``<party>-key.bin`` the wrapped key."""
    key = provider.unwrap(read_file(f"{folder.rstrip('/')}/{party}-key.bin"))
    payload = spark.read.schema("payload string").json(f"{folder.rstrip('/')}/{party}-data.json")
    return decrypt_table(payload.select(F.unbase64("payload").alias("payload")), key, schema), key


def write_encrypted(df: DataFrame, folder: str, party: str, key: bytes, provider: KeyProvider | None = None, kind: str = "output") -> None:
    """``df`` under ``key`` as ``<party>-<kind>.json``; with ``provider`` also the wrapped key."""
    hidden, _ = encrypt_table(df, key)
    hidden.select(F.base64("payload").alias("payload")).write.mode("overwrite").json(f"{folder.rstrip('/')}/{party}-{kind}.json")
    if provider is not None:
        write_file(f"{folder.rstrip('/')}/{party}-key.bin", provider.wrap(key))


def party_paths(folder: str, party: str) -> tuple[str, str]:
    """Input and output of a party in a shared folder."""
    return f"{folder.rstrip('/')}/{party}-data.json", f"{folder.rstrip('/')}/{party}-output.json"


def load_shared_embedder(folders: list[str], salt: str | None = None) -> Embedder:
    """The embedder that all parties hold; an error if their checksums differ."""
    made = [Embedder.load(f, salt=salt) for f in folders]
    if not made:
        raise ValueError("no folder is given")
    if len({e.checksum for e in made}) > 1:
        raise ValueError("the parties' embedders differ")
    return made[0]


def assign_columns(form: Mapping[str, str], functions: Mapping[str, Callable]) -> tuple[list[str], list[str], dict]:
    """Columns to drop, to keep as they are, and those with a feature function, from a mapping of choices."""
    chosen = {c: v for c, v in form.items() if c not in ("salt", "upload", "download") or v in ("drop", "keep")}
    drop, keep = ([c for c, v in chosen.items() if v == kind] for kind in ("drop", "keep"))
    return drop, keep, {c: functions[v] for c, v in chosen.items() if v not in ("drop", "keep")}


def sample_parties(spark: SparkSession, rows: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Two invented tables of ``rows`` people each, the second with slips, for trying things out: ``given_name``, ``surname``, ``street_number``, ``address_1``,
    ``suburb``, ``postcode``, ``state``, ``date_of_birth``, ``soc_sec_id`` as strings, and ``true_id``. The same for the same number of rows."""

    def pick(seed: int, words: str):
        options = words.split()
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("true_id", F.lit(seed)), F.lit(len(options))) + 1).cast("int"))

    def number(seed: int, least: int, span: int):
        return (F.pmod(F.xxhash64("true_id", F.lit(seed)), F.lit(span)) + least).cast("string")

    starts, ends = "al be car do el fa gri ha is jo ka lo mar ni ol pe", "ana bert din fred gar iel lia mon na ric son ton va wen"
    first = spark.range(rows).withColumnRenamed("id", "true_id").select(
        "true_id", F.concat(pick(1, starts), pick(2, ends)).alias("given_name"), F.concat(pick(3, starts), pick(4, ends), pick(5, "berg dale field man ley wood")).alias("surname"),
        number(6, 1, 300).alias("street_number"), F.concat(pick(7, starts), pick(8, ends), F.lit(" "), pick(9, "street road lane place")).alias("address_1"),
        F.concat(pick(10, "north south east west upper lower"), F.lit(" "), pick(11, starts), pick(12, "ham ville port bridge")).alias("suburb"), number(13, 1000, 8000).alias("postcode"),
        pick(14, "nsw vic qld wa sa tas").alias("state"), F.concat(number(15, 1930, 80), F.lpad(number(16, 1, 12), 2, "0"), F.lpad(number(17, 1, 28), 2, "0")).alias("date_of_birth"), number(18, 1_000_000, 8_999_999).alias("soc_sec_id"),
    )

    def slip(c: str, seed: int):
        at = (F.pmod(F.xxhash64("true_id", F.lit(seed)), F.length(c)) + 1).cast("int")
        dropped = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c)))
        return F.when(F.pmod(F.xxhash64("true_id", F.lit(seed + 1)), F.lit(4)) == 0, dropped).otherwise(F.col(c)).alias(c)

    slipped = {"given_name": 21, "surname": 23, "address_1": 25, "date_of_birth": 27}
    second = first.select("true_id", *[slip(c, slipped[c]) if c in slipped else F.col(c) for c in first.columns[1:]])
    return first, second

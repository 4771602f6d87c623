"""``python -m veilink.plans.link_job``: read two embedded tables, match them, write both with a private index.

With ``PRODUCTION`` set, tables come encrypted, each under a data key of its party that is wrapped with the job's public key, and results go out under
the same keys; the private key is in ``PRIVATE_KEY_FILE``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.crypto import RsaKeyProvider
from ..operators.link import perform_matching
from ..sources.config import linkage_settings, settings
from ..sources.files import read_file
from ..sources.tables import load_shared_embedder, party_paths, read_encrypted, read_party, write_encrypted, write_party


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--env", default=".env")
    parser.add_argument("--embedder", action="append", required=True, help="folder of a party's embedder; all must agree")
    parser.add_argument("--id", default="id", help="id column of both tables")
    parser.add_argument("--size", type=int, default=10_000, help="records that both parties together stay under twice of")
    parser.add_argument("--mode", choices=("exact", "sparse"), default="exact")
    parser.add_argument("--schema", default="id string, bf_indices array<int>, bf_norms double, thresholds double", help="columns of encrypted tables")
    args = parser.parse_args(argv)
    job = linkage_settings(settings(args.env))
    spark = SparkSession.builder.appName("link").getOrCreate()
    embedder = load_shared_embedder(args.embedder)
    paths = [party_paths(job["folder"], p) for p in job["parties"]]
    if job["production"]:
        if not job["private_key"]:
            raise ValueError("PRIVATE_KEY_FILE is missing")
        provider = RsaKeyProvider(spark, private=read_file(job["private_key"]).decode())
        (df1, key1), (df2, key2) = (read_encrypted(spark, job["folder"], p, args.schema, provider) for p in job["parties"])
    else:
        df1, df2 = (read_party(spark, source) for source, _ in paths)
    done1, done2, _ = perform_matching(df1, df2, embedder, args.id, args.id, args.size, args.mode)
    if job["production"]:
        for done, party, key in zip((done1, done2), job["parties"], (key1, key2)):
            write_encrypted(done, job["folder"], party, key)
    else:
        for done, (_, target) in zip((done1, done2), paths):
            write_party(done, target, "json")


if __name__ == "__main__":
    main()

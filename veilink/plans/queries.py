"""Queries of the linkage operators over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.bloom import BloomFilter
from ..operators.crypto import decrypt_table, encrypt_table
from ..operators.embed import Embedded, Embedder, party_to_filters
from ..operators.link import match, perform_matching, performance, private_index
from ..operators.similarity import compare, compare_indexed
from ..operators.train import joint_frequencies, train
from ..session import read_table, shared_folder, spread
from ..sources.tables import export_bundle, load_shared_embedder, read_embedded, read_party, write_party
from ..streaming.embed_stream import embed_stream, write_stream
from .oracle import ORACLE_SQL

SALT = "pepper"
OPTIONS = {"shingled": {"label": "instrument"}, "misc": {"label": "county"}}
SPEC_A = {"first_name": "name", "last_name": "name", "gender": "sex", "date_of_birth": "dob", "instrument": "shingled", "county": "misc"}
SPEC_B = {"name": "name", "sex": "sex", "birth_date": "dob", "main_instrument": "shingled", "county": "misc"}
CUTOFF = 0.6


def embedder() -> Embedder:
    return Embedder(BloomFilter(salt=SALT), OPTIONS)


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def party_a(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "df1").select("id", *SPEC_A).dropDuplicates())


def party_b(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "df2").select("personid", *SPEC_B).dropDuplicates())


def embedded_a(spark: SparkSession, d: str, thresholds: bool = False) -> Embedded:
    return embedder().embed(party_a(spark, d), SPEC_A, "id", update_thresholds=thresholds)


def embedded_b(spark: SparkSession, d: str, thresholds: bool = False) -> Embedded:
    return embedder().embed(party_b(spark, d), SPEC_B, "personid", update_thresholds=thresholds)


def suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The suppliers, and the same under other ids with a spelling that loses a digit in every third name."""
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").cast("string").alias("balance"))
    a = s.withColumn("true_id", F.col("s_suppkey"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.regexp_replace("s_name", "0", " ")).otherwise(F.col("s_name"))
    return a, s.select((F.col("s_suppkey") + 1_000_000).alias("other"), name.alias("s_name"), "nation", "balance", F.col("s_suppkey").alias("true_id"))


SUPPLIER_SPEC = {"s_name": "name", "nation": "misc", "balance": "shingled"}


def supplier_pairs(spark: SparkSession, d: str, thresholds: bool = True) -> tuple[Embedded, Embedded]:
    e, (a, b) = embedder(), suppliers(spark, d)
    return e.embed(a, SUPPLIER_SPEC, "s_suppkey", update_thresholds=thresholds), e.embed(b, SUPPLIER_SPEC, "other", update_thresholds=thresholds)


def feat_tokens(spark, d):
    return read_table(spark, d, "part").select("p_partkey", joined(X.tokens(F.col("p_name"))).alias("tokens"))


def feat_ngrams(spark, d):
    return read_table(spark, d, "part").select("p_partkey", joined(X.ngrams(X.tokens(F.col("p_name")), (1, 2, 3))).alias("grams"))


def feat_skip_grams(spark, d):
    return read_table(spark, d, "part").select("p_partkey", joined(X.skip_grams(X.tokens(F.col("p_name")))).alias("grams"))


def feat_double_metaphone(spark, d):
    return read_table(spark, d, "part").select("p_partkey", joined(X.double_metaphone_codes(F.col("p_name"))).alias("codes"))


def feat_strings(spark, d):
    return read_table(spark, d, "part").select("p_partkey", joined(X.string_features(F.col("p_name"), (2, 3), True, True)).alias("features"))


def feat_names(spark, d):
    return party_b(spark, d).select("personid", joined(X.name_features()(F.col("name"))).alias("features"))


def feat_sex(spark, d):
    return party_a(spark, d).select("id", joined(X.sex_features()(F.col("gender"))).alias("features"), F.size(X.sex_features()(F.col("gender"))).cast("bigint").alias("n"))


def feat_dates(spark, d):
    return party_a(spark, d).select("id", joined(X.date_features(default=("missing",))(F.col("date_of_birth"))).alias("features"))


def feat_misc(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", joined(X.misc_features("priority")(F.col("o_orderpriority"))).alias("features"))


def feat_shingled(spark, d):
    return party_a(spark, d).select("id", joined(X.shingled_features(label="instrument")(F.col("instrument"))).alias("features"))


def feat_user(spark, d):
    """A user's own column type beside the built-in ones."""
    e = Embedder(BloomFilter(salt=SALT), factory={"upper": lambda **_: (lambda c: F.array(F.upper(c)))})
    return e.embed(read_table(spark, d, "part"), {"p_name": "upper"}, "p_partkey").df.select("p_partkey", joined(F.col("all_features")).alias("features"))


def bloom_indices(spark, d):
    f = X.name_features()(F.col("c_name"))
    return read_table(spark, d, "customer").select("c_custkey", joined(BloomFilter(salt=SALT).indices(f)).alias("indices"))


def bloom_odd_size(spark, d):
    """A size that isn't a power of two, with an offset: by whole digests."""
    customers = spread(read_table(spark, d, "customer").select("c_custkey", "c_name"))
    made = BloomFilter(1000, 2, 7, SALT).with_indices(customers.select("c_custkey", X.name_features()(F.col("c_name")).alias("features")), F.col("features"), "indices")
    return made.select("c_custkey", joined(F.col("indices")).alias("indices"))


def bloom_collisions(spark, d):
    f = X.name_features()(F.col("c_name"))
    return read_table(spark, d, "customer").select("c_custkey", F.round(BloomFilter(salt=SALT).collision_fraction(f), 6).alias("fraction"))


def embed_columns(spark, d):
    return embedded_a(spark, d).df.select("id", F.size("all_features").cast("bigint").alias("features"), joined(F.col("bf_indices")).alias("indices"), F.round("bf_norms", 6).alias("bf_norms"))


def embed_flagship(spark, d):
    """From a party's table to what it may share."""
    s, _ = suppliers(spark, d)
    made = party_to_filters(s, {"s_name": "name", "nation": "misc"}, "s_suppkey", salt=SALT)
    return made.select("s_suppkey", joined(F.col("bf_indices")).alias("indices"), F.round("bf_norms", 6).alias("bf_norms"), F.round("thresholds", 6).alias("thresholds"))


def anonymised(spark, d):
    return embedded_a(spark, d).anonymise(["county", "id"]).select("id", "county", joined(F.col("bf_indices")).alias("indices"), F.round("bf_norms", 6).alias("bf_norms"))


def thresholds(spark, d):
    return embedded_a(spark, d, thresholds=True).df.select("id", F.round("thresholds", 6).alias("thresholds"))


def compare_pairs(spark, d):
    pairs = compare(embedder(), embedded_a(spark, d), embedded_b(spark, d), require_thresholds=False, least=CUTOFF)
    return pairs.select("id1", "id2", F.round("sim", 6).alias("sim"))


def compare_all(spark, d):
    """The whole matrix of two small tables."""
    pairs = compare(embedder(), *supplier_pairs(spark, d, thresholds=False), require_thresholds=False)
    return pairs.select("id1", "id2", F.round("sim", 6).alias("sim"))


def compare_by_index(spark, d):
    return compare_indexed(*supplier_pairs(spark, d, thresholds=False)).select("id1", "id2", F.round("sim", 6).alias("sim"))


def match_many(spark, d):
    pairs = compare(embedder(), embedded_a(spark, d, True), embedded_b(spark, d, True), least=CUTOFF)
    return match(pairs, abs_cutoff=CUTOFF, mode="many").select("id1", "id2", F.round("sim", 6).alias("sim"))


def match_exact(spark, d):
    return match(compare(embedder(), *supplier_pairs(spark, d)), mode="exact").select("id1", "id2", F.round("sim", 6).alias("sim"))


def match_sparse(spark, d):
    pairs = compare(embedder(), embedded_a(spark, d), embedded_b(spark, d), require_thresholds=False, least=CUTOFF)
    return match(pairs, abs_cutoff=CUTOFF, mode="sparse", require_thresholds=False).select("id1", "id2", F.round("sim", 6).alias("sim"))


def private_index_invariants(spark, d):
    """Of both tables with a private index: rows, distinct values, shared values, values outside the range."""
    (e1, e2), size = supplier_pairs(spark, d), 100_000
    found = match(compare(embedder(), e1, e2), abs_cutoff=0.5, mode="exact", require_thresholds=False)
    a, b = private_index(e1.df, e2.df, found, "s_suppkey", "other", size)
    a, b = a.select("private_index"), b.select("private_index")
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    per = both.groupBy("private_index").agg(F.count("*").alias("n"), F.countDistinct("side").alias("sides"))
    return per.agg(F.sum("n").alias("records"), F.max("n").alias("most"), F.sum((F.col("n") != F.col("sides")).cast("bigint")).alias("repeated"), F.sum((~F.col("private_index").between(size, 3 * size - 1)).cast("bigint")).alias("outside"))


def match_performance(spark, d):
    e1, e2 = supplier_pairs(spark, d)
    a, b = suppliers(spark, d)
    p = performance(match(compare(embedder(), e1, e2), abs_cutoff=0.9, mode="many", require_thresholds=False), a, b, "s_suppkey", "other")
    return p.select("matches", "true_positives", "false_positives", "possible", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def joint_freq(spark, d):
    e1, e2 = supplier_pairs(spark, d, thresholds=False)
    pairs = e1.df.select("s_suppkey", F.col("bf_indices").alias("x")).join(e2.df.select((F.col("other") - 1_000_000).alias("s_suppkey"), F.col("bf_indices").alias("y")), "s_suppkey")
    return joint_frequencies(pairs).select("i", "j", "count")


def trained_scores(spark, d):
    """Similarities of aligned suppliers under a matrix trained on them."""
    e1, e2 = supplier_pairs(spark, d, thresholds=False)
    same = Embedded(e2.df.withColumn("other", F.col("other") - 1_000_000), e2.checksum, "other")
    t = train(embedder(), e1, same, ("s_suppkey", "other"), seed=3)
    x, y = Embedded.from_df(e1.df, t, "s_suppkey"), Embedded.from_df(same.df, t, "other")
    return compare(t, x, y, require_thresholds=False).where("id1 = id2").select("id1", F.round("sim", 4).alias("sim"))


def encrypted_round_trip(spark, d):
    n = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hidden, key = encrypt_table(n)
    return decrypt_table(hidden, key, "c_custkey bigint, c_name string, c_mktsegment string")


def embed_streamed(spark, d):
    """Customers as a stream of files, embedded and appended to a table."""
    root = _folder(spark, "stream")
    source = f"{d}/customer.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "customer.parquet").parquet(d)
    done = embed_stream(stream.select("c_custkey", "c_name"), embedder(), {"c_name": "name"}, "c_custkey")
    write_stream(done, f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/data").select("c_custkey", joined(F.col("bf_indices")).alias("indices"), F.round("bf_norms", 6).alias("bf_norms"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def csv_round_trip(spark, d):
    """Party A written as CSV and read again: strings, nulls as empty strings."""
    at = f"{_folder(spark, 'csv')}/a.csv"
    write_party(party_a(spark, d), at, "csv")
    return read_party(spark, at).select(F.col("id").cast("int").alias("id"), *SPEC_A)


def json_round_trip(spark, d):
    """Anonymised filters of customers written as JSON and tied to their embedder again."""
    at = f"{_folder(spark, 'json')}/c.json"
    made = embedder().embed(read_table(spark, d, "customer"), {"c_name": "name"}, "c_custkey")
    write_party(made.anonymise(["c_custkey"]), at, "json")
    back = read_embedded(spark, at, embedder(), "c_custkey")
    return back.df.select("c_custkey", joined(F.col("bf_indices")).alias("indices"), F.round("bf_norms", 6).alias("bf_norms"))


def shared_bundle(spark, d):
    """What a party's bundle holds: the id, filters and norms of each record, and an embedder of the same checksum."""
    folder, e = _folder(spark, "bundle"), embedder()
    export_bundle(e.embed(read_table(spark, d, "customer"), {"c_name": "name"}, "c_custkey"), e, folder)
    same = load_shared_embedder([f"{folder}/embedder"] * 2).checksum == e.checksum
    back = read_party(spark, f"{folder}/data", "csv")
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.array_join(F.from_json("bf_indices", "array<int>"), "|").alias("indices"), F.lit(len(back.columns)).cast("bigint").alias("columns"), F.lit(same).alias("same_embedder"))


def saved_embedder(spark, d):
    """An embedder saved and loaded again by URI makes the same filters."""
    folder = _folder(spark, "embedder")
    embedder().save(folder if "://" in folder else f"file://{folder}")
    back = Embedder.load(folder if "://" in folder else f"file://{folder}", salt=SALT)
    return back.embed(read_table(spark, d, "customer"), {"c_name": "name"}, "c_custkey").df.select("c_custkey", joined(F.col("bf_indices")).alias("indices"))


def matched_parties(spark, d):
    """Two embedded tables through the whole job: records that share a private index afterwards."""
    e1, e2 = supplier_pairs(spark, d)
    out1, out2, _ = perform_matching(e1.anonymise(["s_suppkey"]), e2.anonymise(["other"]), embedder(), "s_suppkey", "other", 100_000)
    return out1.select("s_suppkey", "private_index").join(out2.select("other", "private_index"), "private_index").select("s_suppkey", "other")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        embed_flagship, feat_tokens, feat_ngrams, feat_skip_grams, feat_double_metaphone, feat_strings, feat_names, feat_sex, feat_dates, feat_misc, feat_shingled, feat_user,
        bloom_indices, bloom_odd_size, bloom_collisions, embed_columns, anonymised, thresholds, compare_pairs, compare_all, compare_by_index, match_many, match_exact, match_sparse,
        private_index_invariants, match_performance, joint_freq, trained_scores, encrypted_round_trip, embed_streamed,
        csv_round_trip, json_round_trip, shared_bundle, saved_embedder, matched_parties,
    )
}
__all__ = ["QUERIES", "ORACLE_SQL", "embed_flagship"]

"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .linkage import link_people
from .lookalike import found_lookalikes
from .mixture import mix_report, mix_sources
from .neighbours import nearest_rows, repaired_norms
from .pivots import bound_replication, similar_row_links, similar_rows
from .spans import shared_fraction, shared_spans
from .tokens import decode_ids, encode_corpus
from .variants import link_variants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rows(read_table(spark, d, "embedded_df")).select("row_a", "row_b")


def p1_norms(spark: SparkSession, d: str) -> DataFrame:
    fixed = repaired_norms(read_table(spark, d, "embedded_df"))
    return fixed.select("row_id", F.round("bf_norms", 6).alias("bf_norms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_confidence(spark, d).select("id", "personid")


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return link_people(read_table(spark, d, "df1"), read_table(spark, d, "df2"), read_table(spark, d, "short_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_rarity(spark, d).select("id_a", "id_b")


def p3_rarity(spark: SparkSession, d: str) -> DataFrame:
    return link_variants(read_table(spark, d, "df1"), read_table(spark, d, "short_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_rows(read_table(spark, d, "embedded_df"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return similar_row_links(read_table(spark, d, "embedded_df"))


def p4_bound(spark: SparkSession, d: str) -> DataFrame:
    return bound_replication(read_table(spark, d, "embedded_df"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return found_lookalikes(read_table(spark, d, "df1"), read_table(spark, d, "name_list"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that decoding doesn't give back (none), with the documents seen."""
    docs = encode_corpus(read_table(spark, d, "documents").select("doc_id", "text"))
    lost = ~decode_ids(F.col("ids")).eqNullSafe(F.coalesce("text", F.lit("")))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(lost.cast("bigint")), F.lit(0)).alias("lost"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p7_selection(spark, d), read_table(spark, d, "mix_targets"))


def p7_full(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mixture as large as all targeted records: sources at their cap fall short, and siblings take what they can't give."""
    targets = read_table(spark, d, "mix_targets")
    return mix_report(mix_sources(read_table(spark, d, "documents"), targets, total_tokens="all"), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(read_table(spark, d, "documents"))


def p8_fraction(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return shared_fraction(docs, shared_spans(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_norms, p2_found, p2_confidence, p3_found, p3_rarity, p4_found, p4_links, p4_bound, p5_found, p6_ids, p6_round_trip, p7_selection, p7_shares, p7_full, p8_found, p8_fraction)
}

ORACLE_SQL: dict[str, str] = {
    # the true norm, or the stored one where it agrees to six decimals: equal after rounding
    "p1_norms": """
        SELECT row_id, CASE WHEN bf_norms IS NULL OR isnan(bf_norms) OR abs(bf_norms - n) > 1e-6 THEN round(n, 6) ELSE round(bf_norms, 6) END AS bf_norms
        FROM (SELECT *, sqrt(coalesce(len(list_distinct(bf_indices)), 0)::DOUBLE) AS n FROM embedded_df)""",
    "p6_round_trip": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS lost FROM documents",
}

"""Queries of the text operators. SQL that states the same result is given where it is feasible on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.lookalike import plain_texts
from shelfspark.llm.packing import faults, fill, pack_all
from shelfspark.llm.product_match import same_item_classes, same_item_pairs
from shelfspark.llm.residue import residue
from shelfspark.llm.subjects import document_subjects
from shelfspark.llm.survivors import surviving_records, surviving_values
from shelfspark.llm.tokens import decode, encode
from shelfspark.session import load_table, materialize

TEXT_FIELDS = ("product_name", "description")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a character that could be plainer without a visible difference."""
    return plain_texts(load_table(spark, sf_dir, "products"), "row_id", TEXT_FIELDS).filter("changed").select("row_id", "field_name")


def p1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of each such value."""
    return plain_texts(load_table(spark, sf_dir, "products"), "row_id", TEXT_FIELDS).filter("changed").select("row_id", "field_name", "plain_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_item_pairs(load_table(spark, sf_dir, "products"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row that has a row of another shop in it, and the number of those."""
    return same_item_classes(load_table(spark, sf_dir, "products"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(load_table(spark, sf_dir, "products"), "row_id", TEXT_FIELDS).select("row_id", "field_name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_values(load_table(spark, sf_dir, "products"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each listing with several captures."""
    return surviving_records(load_table(spark, sf_dir, "products"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of its ids, and whether they read back as its text."""
    encoded = encode(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = decode(F.col("ids")) == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), same.alias("same_text"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of each document read back as."""
    encoded = encode(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", decode(F.col("ids")).alias("decoded"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size("ids").alias("n_tokens"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document assigned to containers of each capacity."""
    return pack_all(_sizes(spark, sf_dir), load_table(spark, sf_dir, "containers"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are, beside the least number of them."""
    return fill(p9_packed(spark, sf_dir), load_table(spark, sf_dir, "containers"))


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each capacity, those not packed once and whole, and containers that hold too much."""
    sizes, containers = materialize(_sizes(spark, sf_dir)), load_table(spark, sf_dir, "containers")
    return faults(materialize(pack_all(sizes, containers)), sizes, containers)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (load_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects"))
    return document_subjects(*tables)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject."""
    return p10_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_plain, p2_found, p2_classes, p5_found, p7_found, p7_records, p8_ids, p8_decoded, p8_round_trip, p9_packed, p9_fill, p9_checked, p10_found, p10_composition)
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it is feasible on whole tables; the other operators are tested against brute force, the tokenizer, round trips and held-out texts."""
    return {
        "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
        "p9_checked": """SELECT container_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS wrong_documents, CAST(0 AS BIGINT) AS overfull
FROM (SELECT DISTINCT container_id FROM containers WHERE capacity_tokens > 0 AND container_id IS NOT NULL)""",
    }

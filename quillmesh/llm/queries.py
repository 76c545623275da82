"""Queries of the problems on text and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import leaks, neighbours, packing, pairs, subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.function_pairs(table(spark, d, "source_files")).select("location", "qual_name").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.function_pairs(table(spark, d, "source_files"))


def _neighbours(spark: SparkSession, d: str, least: float | None) -> DataFrame:
    usable = neighbours.current_vectors(table(spark, d, "vec_embeddings"), table(spark, d, "embedding_hashes"), 64)
    return neighbours.nearest(usable, 64, 10, least)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d, 0.85)
    return near.select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, None)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents")), table(spark, d, "pack_plans"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return packing.usage(packing.pack(packing.sized(table(spark, d, "documents")), plans), plans)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    near = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return near.filter(F.col("exact_run") >= leaks.WINDOW).select("doc_id", "item_id").distinct()


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_examples")).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    got = subjects.document_subjects(docs, table(spark, d, "subject_examples"))
    return got.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p6_found, p6_neighbours, p8_packed, p8_usage, p9_found, p9_near, p10_found, p10_composition)}
SQL: dict[str, str] = {}

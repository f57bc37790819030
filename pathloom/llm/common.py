"""Helpers that the corpus operators share: reading and normalising; staging is the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.staging import shared_folder, small_batches, staged  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def without(docs: DataFrame, dropped: DataFrame, mark: Column | None = None) -> DataFrame:
    """The columns of documents of docs, less the rows that are in dropped (unique per document, so no key is hot).

    dropped: (doc_id), or (doc_id, mark) if mark is given, an expression over docs; then a row goes only if both agree,
    so rows without doc_id and rows that share one are told apart by their texts.
    """
    gone = dropped.select(F.col("doc_id").alias("_gone"), *([] if mark is None else [F.col("mark").alias("_gone_mark")]))
    same = F.col("doc_id").eqNullSafe(F.col("_gone"))
    if mark is None:
        return docs.select(DOCUMENT_COLUMNS).join(gone, same, "left_anti")
    return docs.select(*DOCUMENT_COLUMNS, mark.alias("_mark")).join(gone, same & (F.col("_mark") == F.col("_gone_mark")), "left_anti").drop("_mark")

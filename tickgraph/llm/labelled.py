"""Labelled samples of a bounded size, and which rows may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled documents that may be learned from, chosen by a hash of the id.

    The chosen ids, at most `most`, are broadcast to the scan of the documents. Labels other than 0 and 1, null ids and
    ids with two different labels are left out; null text counts as empty; of repeated rows one is taken.
    """
    rows = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("z")).where("y = z").drop("z")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

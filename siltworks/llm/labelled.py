"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id="doc_id"):
    """Rows that no model learns from: crc32 of the id as text has remainder 0 by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``most[k]`` documents of label k, 0 or 1, none held out; which ones depends on a hash of their ids alone."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[value])
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most sum(most) rows

"""The stages of a training corpus from raw documents: quality, exact and near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, decontaminate, exact_dedup, near_copies, quality
from siltworks.llm.shared import drop, rank_file, scratch, split_by, stored, table


def _row():
    """A hash of id and text, both null-safe: the same for rows of the same document only."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit(""))).alias("row")


def _kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (row, kept) keeps, repeated ones once. Only rows that may go or repeat are shuffled."""
    with scratch(docs.sparkSession) as keep:
        changed = stored(judged.groupBy("row").agg(F.count("*").alias("n"), F.every("kept").alias("kept")).filter("n > 1 OR NOT kept"), "changed")
        may, same, few = split_by(docs.withColumn("row", _row()), ["row"], changed)
        keep(changed, few)
    return same.drop("row").unionByName(may.join(changed.filter("NOT kept"), "row", "left_anti").dropDuplicates(["row"]).select(docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of equal texts; a group of null ids alone keeps one row.

    A kept id stands only for its own text: where different texts have one id, each is judged on its own.
    """
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that near copies connect: those whose sets of five-word shingles have a similarity of 0.8 or more.

    Null ids come last. Rows with the same id and text are one; of different texts with one id each is a document of its own.
    """
    rows = docs.select(_row(), "doc_id", "text")
    found = near_copies.near_copies(rows, 5, 0.8).select("row", "kept")
    return _kept(docs, rows.select("row", F.lit(True).alias("kept")).unionByName(found.filter("NOT kept")))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item.

    Each text is judged on its own, also where its id is null or another text has it. Rows with the same id and text are one.
    """
    found = decontaminate.decontaminate(docs.select(_row().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _kept(docs, found.select(F.col("doc_id").alias("row"), (~F.col("contaminated")).alias("kept")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    coded = bpe.round_trip(docs, rank_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmarks), ("bpe", tokens)]

#: SQL expresses neither the classifier nor the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written, then what it was made of is deleted; only the last one's stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            drop(before)
        before = docs
    return docs

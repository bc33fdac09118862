"""Operator 9, exact dedup: an extendible-hash index in shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm.shared import scratch, split_by, stored

#: Bits of the directory at most: it never has more than 2**16 rows, which bounds its broadcast.
DIRECTORY_BITS = 16
#: Keys that a bucket holds before it splits, and bits of a key.
CAPACITY, KEY_BITS = 4096, 60


def normalised(text):
    """Each run of ASCII white space as one space; null counts as empty. Single spaces are not touched, which is the same and cheaper."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """(slot, depth, bucket) for each used slot of 2**DIRECTORY_BITS.

    A bucket starts as the whole key space at depth 0. Wherever it holds over ``capacity`` keys the directory
    doubles and the bucket splits by the next bit, down to DIRECTORY_BITS; what is still overfull there chains on.
    So a slot's bucket is its shortest key prefix with at most ``capacity`` keys.
    """
    at = keys.groupBy("slot").agg(F.count("*").alias("n"))
    depths = F.expr(f"explode(transform(sequence(0, {DIRECTORY_BITS}), d -> struct(d AS depth, shiftright(slot, {DIRECTORY_BITS} - d) AS prefix)))")
    tried = at.select("slot", "n", depths.alias("x")).select("slot", "n", "x.*")
    held = tried.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    # there are at most 2**17 prefixes
    fits = tried.join(F.broadcast(held), ["depth", "prefix"]).filter((F.col("held") <= capacity) | (F.col("depth") == DIRECTORY_BITS))
    return (
        fits.groupBy("slot")
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {DIRECTORY_BITS} - depth), {DIRECTORY_BITS} - depth)"))
    )


def hashed(docs: DataFrame, key_bits: int) -> DataFrame:
    """The stored rows of ``docs`` with the SHA-256 of their normalised text, its key of ``key_bits`` bits, the key's slot and a number (at).

    The key is the start of a 64-bit hash.
    """
    once = docs.withColumn("norm", normalised(F.col("text"))).withColumn("key", F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits))
    slot = F.shiftleft("key", DIRECTORY_BITS - key_bits) if key_bits < DIRECTORY_BITS else F.shiftrightunsigned("key", key_bits - DIRECTORY_BITS)
    return stored(once.select(*docs.columns, "key", slot.cast("int").alias("slot"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("at")), "texts")


def build_index(texts: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """The stored (directory, index) of ``texts``, as ``hashed`` returns it, and ``texts`` split by whether a row may have copies.

    directory: slot, depth, bucket. index: bucket, depth, key, link, text_sha256, keep_id, keep_at, group_size.

    Inserts are pre-aggregated by key in each input task, so a key that a third of all rows have sends one row a task. A key that
    one row has is an entry as it stands. Where several rows have a key their texts are fetched and compared byte by byte within the
    key, again a partial aggregation first; texts that differ are a chain of entries, numbered by ``link``. So copies are found in
    the buckets' keys, and only texts whose key may be shared are moved. Owner tasks each write one range of buckets.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("best")
    sums = [F.count("*").alias("group_size"), least, F.min("text_sha256").alias("text_sha256")]
    keys = stored(texts.groupBy("slot", "key").agg(*sums), "keys")
    slots = stored(directory(keys, capacity), "directory")
    shared = keys.filter("group_size > 1").select("slot", "key")
    parts = split_by(texts, ["slot", "key"], shared)
    alone = split_by(keys, ["slot", "key"], shared)[1]
    compared = parts[0].withColumn("norm", normalised(F.col("text"))).groupBy("slot", "key", "norm").agg(*sums)
    entries = stored(alone.unionByName(compared.drop("norm")), "entries")
    owned = entries.join(F.broadcast(slots), "slot").repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    linked = owned.withColumn("link", F.row_number().over(chain) - 1).sortWithinPartitions("bucket", "key", "link")
    return slots, stored(linked.select("bucket", "depth", "key", "link", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size"), "index"), parts


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space became one space; the row with the least
    doc_id stays. Null texts equal empty ones. Rows repeated with the same doc_id are one document: each of them gets the same
    answer. A null doc_id is never kept before another; a group of nulls alone keeps them. Other columns of
    ``docs`` are not read. An empty table gives none. ``capacity``: keys a bucket; ``key_bits``: 1 to 60, less of them only to
    test collisions. Native expressions only.
    """
    with scratch(docs.sparkSession) as keep:
        texts = hashed(docs.select("doc_id", "text"), key_bits)
        slots, index, _ = build_index(texts, capacity)
        asked = stored(texts.select("doc_id", "slot", "key", "text_sha256"), "asked")
        keep(slots, index, asked)
    asked = asked.join(F.broadcast(slots.select("slot", "bucket")), "slot")
    found = asked.join(index.select("bucket", "key", "text_sha256", "keep_id", "group_size"), ["bucket", "key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row of ``docs`` for each of its texts, with all its columns: the one that ``exact_dedup`` keeps; of repeated rows with its doc_id one."""
    with scratch(docs.sparkSession) as keep:
        texts = hashed(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text"), key_bits)
        _, index, (may, alone, few) = build_index(texts, capacity)
        keep(texts, index, few)
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return alone.select(own).unionByName(may.join(index.select(F.col("keep_at").alias("at")), "at", "left_semi").select(own))

"""Operator 6 where similarity of word shingles is asked for: SimHash fingerprints with the pivot table and bands of bits propose, then bands of minima what 4 bits can't reach; shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.components import components
from siltworks.llm.shared import scratch, split_by, stored
from siltworks.llm.simhash import fingerprint_links, majority

#: Bands of minima. At similarity s a pair shares none with probability (1 - s**ROWS)**BANDS: 6e-5 at 0.8, 3e-7 at 0.85, 3e-11 at 0.9; at 0.25, as where
#: half of each text is a common passage, it shares one with probability 0.008.
BANDS, ROWS = 32, 6
_RNG = np.random.default_rng(42)
XORS, ODDS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32), _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
#: A SimHash fingerprint of so many words of 64 bits. Sets of fewer shingles have none that is good enough.
WIDE, LEAST = 24, 64
SALTS = _RNG.integers(0, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words, A-Z lower-cased. Fewer words are one shingle; no words give none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    known = {w: xxh64_intdigest(w, 42) for w in set(words)}
    hashes, n = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out * MIX[0]) ^ (hashes[j : j + n] + (out >> np.uint64(29)))
    out = (out ^ (out >> np.uint64(32))) * MIX[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of a set of shingles; sets that have the band's minima in common share it."""
    least, half = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(half), 2048):
        least = np.minimum(least, ((half[None, lo : lo + 2048] ^ XORS) * ODDS).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * MIX[0]
        key ^= key >> np.uint64(31)
    return key


def wide(found: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set of shingles, in WIDE words."""
    mixed = np.multiply.outer(found ^ (found >> np.uint64(32)), SALTS)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[1]
    return majority((mixed ^ (mixed >> np.uint64(32))).ravel(), WIDE)


def most_bits(at_least: float) -> int:
    """Differing bits that fingerprints of sets with that similarity have at most, but for one pair in 30,000: four deviations above the mean.

    The cosine is least, at 2s / (1 + s), where the sets are of one size.
    """
    p = math.acos(2 * at_least / (1 + at_least)) / math.pi
    return math.ceil(64 * WIDE * p + 4 * math.sqrt(64 * WIDE * p * (1 - p)))


def signature_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        nodes, prints, sizes, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), [], []
        for i, text in enumerate(batch.column("text")):
            found = shingles(text.as_py(), width)
            nodes[i], prints[i] = xxh64_intdigest(found.tobytes(), 42), majority(found)[0]
            sizes.append(len(found))
            keys.append(bands(found).view(np.int64) if len(found) else [])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "node", "fp", "n", "bands"])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(x.as_py(), width).tobytes() for x in batch.column("text")], pa.binary())], ["node", "words"])


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [wide(np.frombuffer(x.as_py(), np.uint64)).view(np.int64) for x in batch.column("words")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints, pa.list_(pa.int64()))], ["node", "print"])


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, words in zip(batch.column("node").to_pylist(), batch.column("words")):
            found = np.frombuffer(words.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "shingle"])


def pair_batches(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose shared shingles are at least ``at_least`` of all that either has."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("a_words"), batch.column("b_words")):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= at_least * (len(a) + len(b) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def fingerprint_pairs(nodes: DataFrame, at_least: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp, n) that operator 6 links: fingerprints at 4 or fewer differing bits, found in bands of bits with the table of distances to pivots.

    Sets with one fingerprint are tried against the least of them, and those against each other along the links, so a group of any size has no more pairs than members and links.
    Sets whose sizes alone rule out a similarity of ``at_least`` are left out.
    """
    least = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", F.col("x.node").alias("b"), F.col("x.n").alias("other_n")), "firsts")
    links = fingerprint_links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(end), F.col("b").alias(node), F.col("other_n").alias(n)) for end, node, n in (("src", "node", "n"), ("dst", "b", "other_n"))]
    pairs = nodes.select("fp", "node", "n").join(least, "fp").drop("fp").unionByName(links.join(ends[0], "src").join(ends[1], "dst").drop("src", "dst"))
    fits = F.least("n", "other_n") >= at_least * F.greatest("n", "other_n") - 1e-9
    return pairs.filter((F.col("node") != F.col("b")) & fits).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, width: int = 5, at_least: float = 0.8, stars: int = 2) -> DataFrame:
    """One row per distinct ``row`` of ``docs`` (row, doc_id, text): row, doc_id, root, kept.

    Documents link if the sets of their shingles of ``width`` words have a Jaccard similarity of ``at_least`` or more; of each group
    that links connect, the least doc_id is kept (nulls last, of equals the least row). Texts without words, null ones too, are equal.

    Operator 6 goes first: sets whose SimHash fingerprints it links are candidates. That reaches close copies only (at 0.8 fingerprints differ by 10 bits in the mean),
    so of sets that are not yet in one group those that share a band of their minima are candidates too. For ``stars`` rounds each band tries its members against one of them, so that a large group
    that does link is never all pairs; then the pairs of a band that no link connects yet meet in a join, whose condition discards those whose
    fingerprints differ by more bits than similar sets have. What survives is verified by the whole sets. ``row`` must be the same for equal rows only.
    """
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("row", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        marked = rows.select("row", "doc_id", "text").mapInArrow(lambda it: signature_batches(it, width), "row bigint, doc_id bigint, node bigint, fp bigint, n bigint, bands array<bigint>")
        marked = stored(marked, "signatures")
        nodes = marked.groupBy("node").agg(F.min("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("row"))
        nodes = stored(nodes.filter("n > 0"), "nodes")
        pairs = stored(fingerprint_pairs(nodes, at_least), "pairs")
        dealt = nodes.select(F.explode("bands").alias("band"), "node", "n")
        shared = stored(dealt.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band"), "shared")
        dealt = stored(dealt.join(shared, "band"), "dealt")  # nodes that share a band with another
        asked = dealt.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
        asked = stored(asked.join(nodes.select("node", "row"), "node"), "asked")
        sets = split_by(rows, ["row"], asked)[0].join(asked, "row").select("node", "text").dropDuplicates(["node"]).mapInArrow(lambda it: set_batches(it, width), "node bigint, words binary")
        sets = stored(sets, "sets")
        # shingles that no other candidate has can't be shared, which bounds what a set can have in common with any
        own = sets.mapInArrow(shingle_batches, "node bigint, shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
        own = stored(own.groupBy("node").agg(F.count("*").alias("own")), "own")
        dealt = dealt.join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        dealt = stored(dealt.filter(F.col("most") >= at_least * F.col("n") - 1e-9), "linkable")
        close = F.expr(f"root <> other_root AND (1 + {at_least}) * least(most, other_most) >= {at_least} * (n + other_n) - 1e-9")
        apart = F.expr(" + ".join(f"bit_count(print[{i}] ^ other_print[{i}])" for i in range(WIDE)))
        alike = (F.least("n", "other_n") < LEAST) | (apart <= most_bits(at_least))
        once = F.col("band") == F.array_min(F.array_intersect("bands", "other_bands"))  # of the bands that a pair shares, one
        tried, links = None, None
        for k in range(-1, stars + 1):  # -1: the pairs of the fingerprints
            if 0 <= k < stars:
                centre = now.groupBy("band").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("other_n"), F.col("most").alias("other_most"), F.col("root").alias("other_root")), F.xxhash64(F.lit(k), "node")).alias("x"))
                pairs = now.join(stored(centre.select("band", "x.*"), "centres"), "band").filter(close)
            elif k == stars:
                mixed = stored(now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band"), "mixed")
                prints = stored(sets.mapInArrow(print_batches, "node bigint, print array<bigint>"), "prints")
                # members of a band's largest group meet those outside of it, never each other, so an outsider in the band of a large group costs its size, not its square
                sizes = now.join(mixed, "band").groupBy("band", "root").agg(F.count("*").alias("size"))
                largest = stored(sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("largest")), "largest")
                rest = stored(now.join(largest, "band").join(nodes.select("node", "bands"), "node").join(prints, "node"), "rest")
                other = rest.select("band", F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("n", "most", "root", "print", "bands")])
                pairs = rest.filter("root <> largest").join(other, "band").filter(F.expr("other_root = largest OR node < b") & close & alike & once)
            if tried is not None:
                pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
                pairs = stored(pairs, "pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            both = pairs.join(sets.withColumnsRenamed({"node": "a", "words": "a_words"}), "a").join(sets.withColumnsRenamed({"node": "b", "words": "b_words"}), "b")
            found = stored(both.select("a", "b", "a_words", "b_words").mapInArrow(lambda it: pair_batches(it, at_least), "a bigint, b bigint"), "found")
            links = found if links is None else links.unionByName(found)
            roots = stored(components(links, "a", "b") if k >= stars - 1 else components(links, "a", "b", 2, settle=False), "roots")
            now = dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            if k < stars:
                now = stored(now, "now")
        rooted = stored(marked.select("row", "doc_id", "node").distinct().join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
        best = stored(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select("root", F.col("best.row").alias("best")), "best")
        keep(rooted, best)
    return rooted.join(best, "root").select("row", "doc_id", "root", (F.col("row") == F.col("best")).alias("kept"))

"""Operator 6, SimHash near-dedup: a table of distances to pivots discards pairs of fingerprints that meet in a band."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.components import components
from siltworks.llm.shared import scratch, stored

#: Bits of the blocks of a fingerprint. With at most 4 bits changed, at least 3 of the 7 blocks are equal.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: A band with too many fingerprints is cut anew: its free bits into so many pieces, of which at least so many are equal. So often at most.
PIECES, EQUAL, CUTS = 6, 2, 3
#: Reference fingerprints: bit i of pivot j is the parity of i & j, rows of a Hadamard matrix, any two of which differ in 32 bits.
PIVOTS = tuple(sum(((i & j).bit_count() & 1) << i for i in range(64)) for j in (0, 1, 2, 4, 8, 16, 32, 63, 3, 5, 10, 20, 40, 17, 34, 51))


def signed(x: int) -> int:
    """An unsigned 64-bit integer as a bigint."""
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of hashes of ``words`` 64-bit words each, so many words: a bit is 1 if set in over half of the hashes; 0 of none."""
    ones, n, step = np.zeros(64 * words, np.int64), len(hashes) // words, words << 12
    for lo in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[lo : lo + step].view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or b"").lower().split()
            if not words:
                continue
            shingles = zip(*(words[j:] for j in range(width))) if len(words) >= width else [words]
            out[i] = majority(np.fromiter((xxh64_intdigest(b" ".join(x), 42) for x in shingles), np.uint64, max(1, len(words) - width + 1)))[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of each row: XXH64 (seed 42) of the shingles of ``width`` words, A-Z lower-cased; a bit is set if over half have it.

    Fewer words than ``width`` are one shingle; none, or a null text, gives zero.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lambda it: fingerprint_batches(it, width), "doc_id bigint, fp bigint")


def with_pivots(distinct: DataFrame) -> DataFrame:
    """The pivot table: beside each fingerprint its distances to the pivots, a byte each, in the bigints p0 and p1."""
    halves = {}
    for k in (0, 1):
        column = F.lit(0).cast("bigint")
        for j, pivot in enumerate(PIVOTS[8 * k : 8 * k + 8]):
            far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(pivot)).cast("bigint"))).cast("bigint")
            column = column.bitwiseOR(F.shiftleft(far, 8 * j))
        halves[f"p{k}"] = column
    return distinct.withColumns(halves)


def coordinates(p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """A row of distances to the pivots for each pair of bigints."""
    return np.column_stack([p0, p1]).astype("<i8").view(np.int8).reshape(-1, len(PIVOTS))


def forest(fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links fingerprints at ``bits`` or fewer differing bits.

    Breadth first over what is not reached yet. ``table`` has the distances of each to the pivots. Sorted by the first, only those within
    ``bits`` of it are looked at; a pair whose distances to any pivot differ by over ``bits`` can't link and is discarded, and what survives is verified.
    """
    order = np.lexsort((fps, table[:, 0]))
    fps, table = fps[order], table[order]
    rest, src, dst = np.arange(len(fps)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            first = table[rest, 0]  # sorted
            near = np.arange(np.searchsorted(first, table[x, 0] - bits), np.searchsorted(first, table[x, 0] + bits, "right"))
            for j in range(1, len(PIVOTS)):
                if len(near) < 64:
                    break
                near = near[np.abs(table[rest[near], j] - table[x, j]) <= bits]
            if len(near):
                near = near[np.abs(table[rest[near]] - table[x]).max(1) <= bits]
            if len(near):
                near = near[np.bitwise_count(fps[rest[near]] ^ fps[x]) <= bits]
            if len(near):
                got = rest[near]
                rest = np.delete(rest, near)
                src.append(np.full(len(got), fps[x]))
                dst.append(fps[got])
                queue.extend(got.tolist())
    none = np.empty(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def band_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(src, dst) within each band, from rows (mask, value, fp, p0, p1) sorted by the first two."""
    held: list[np.ndarray] = []

    def close(rows):
        if len(rows) < 2:
            return
        src, dst = forest(rows[:, 2].astype(np.int64).view(np.uint64), coordinates(rows[:, 3], rows[:, 4]), bits)
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
        if not len(rows):
            continue
        cuts = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
        if held and (held[0][0, :2] != rows[0, :2]).any():
            yield from close(np.concatenate(held))
            held = []
        for i in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(rows))):
            part = rows[starts[i] : ends[i]]
            if ends[i] == len(rows):
                held.append(part)
            elif held:
                yield from close(np.concatenate([*held, part]))
                held = []
            else:
                yield from close(part)
    if held:
        yield from close(np.concatenate(held))


def finer(mask: int) -> list[int]:
    """The masks of the bands that a band with the shared bits ``mask`` is cut into."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    pieces = [sum(free[len(free) * k // PIECES : len(free) * (k + 1) // PIECES]) for k in range(PIECES)]
    return [mask | sum(some) for some in combinations(pieces, EQUAL)]


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp, p0, p1) of bands dealt to the finer ones."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            masks = part.column("mask").to_numpy().view(np.uint64)
            for m in set(masks.tolist()) - known.keys():
                known[m] = np.array(finer(m), np.uint64)
            to = np.array([known[m] for m in masks.tolist()])
            fp, p0, p1 = (np.repeat(part.column(c).to_numpy(), to.shape[1]) for c in ("fp", "p0", "p1"))
            mask = to.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mask.view(np.int64), (fp.view(np.uint64) & mask).view(np.int64), fp, p0, p1)], ["mask", "value", "fp", "p0", "p1"])


BANDED = "mask bigint, value bigint, fp bigint, p0 bigint, p1 bigint"


def fingerprint_links(distinct: DataFrame, bits: int = 4, block: int = 32768) -> DataFrame:
    """(src, dst): edges that connect exactly the fingerprints (column fp, distinct) that chains of links of up to ``bits`` <= 4 connect.

    Two fingerprints at 4 or fewer differing bits share 3 of 7 blocks of bits, so each is dealt to its 35 bands with its row of the pivot
    table. In a band a spanning forest is found, never all pairs: pivots discard before any bits are counted. A band of over
    ``block`` fingerprints is dealt to 15 finer ones, which share 12 more bits; links have two of the six pieces of the free bits in common.
    Cut three times, a band has at most 12 free bits and so 4,096 fingerprints: no task holds more, however many look alike.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bands are for 0 to 4 differing bits")
    at, ones = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))], [(1 << b) - 1 for b in BLOCKS]
    masks = [signed(sum(ones[b] << at[b] for b in three)) for three in combinations(range(len(BLOCKS)), 3)]
    table = stored(with_pivots(distinct.select("fp")), "pivots")
    bands = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("value")) for m in masks]))
    dealt, out = table.select(bands.alias("band"), "fp", "p0", "p1").select("band.*", "fp", "p0", "p1"), None
    for k in range(CUTS + 1):
        large = None
        if k < CUTS:
            large = stored(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("mask", "value"), "large")
            rest = dealt.join(large, ["mask", "value"], "left_anti")
        else:
            rest = dealt
        found = rest.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(lambda it: band_batches(it, bits), "src bigint, dst bigint")
        found = stored(found, "links")
        out = found if out is None else out.unionByName(found)
        if large is None or large.isEmpty():
            break
        dealt = stored(dealt.join(large, ["mask", "value"], "left_semi").select("mask", "value", "fp", "p0", "p1").mapInArrow(cut_batches, BANDED), "finer")
    return out


def near_dedup(docs: DataFrame, width: int = 4, bits: int = 4, block: int = 32768) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach).

    Fingerprints link at ``bits`` or fewer differing bits; equal ones always. A text without words, empty or null, has fingerprint
    zero and links like any other. Repeated rows get the same answer; a null doc_id gets a row but never names a component
    that has another. Only doc_id and text are read.
    """
    with scratch(docs.sparkSession) as keep:
        marked = stored(fingerprints(docs, width), "fingerprints")
        distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(fingerprint_links(distinct.select("fp"), bits, block), "src", "dst")
        rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = stored(rooted, "rooted")
        names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
        named = stored(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"), "named")
        keep(marked, named)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltworks.llm.components import components
from siltworks.llm.exact_dedup import build_index, exact_dedup, hashed, keep_first
from siltworks.llm.simhash import PIVOTS, coordinates, finer, fingerprint_links, forest, near_dedup, with_pivots

DOCS = "doc_id bigint, text string, key string, bucket int, fp string"
TEXTS = [None, "", " ", "  ", "a  b", "a\tb", "a b", "A b", "ä b", "ä b", "x " * 30000, "x  " * 30000, "\n", "a b"]


def union(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def docs_of(spark, texts, first=10):
    return spark.createDataFrame([(first + i, t, "k", 1, "f") for i, t in enumerate(texts)], DOCS)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


@pytest.mark.parametrize(("capacity", "key_bits"), [(1000, 60), (1, 60), (2, 3), (1, 1), (3, 18)])
def test_exact(spark, capacity, key_bits):
    docs = docs_of(spark, TEXTS)
    got = sorted(tuple(r) for r in exact_dedup(docs, capacity, key_bits).collect())
    assert got == exact_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_repeated_rows_and_empty(spark):
    docs = docs_of(spark, ["a", "b"])
    twice = docs.union(docs)
    assert sorted(tuple(r)[:4] for r in exact_dedup(twice).collect()) == [(10, 10, 2, True)] * 2 + [(11, 11, 2, True)] * 2
    assert exact_dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(nulls).collect()} == {(None, 3, False), (3, 3, True), (None, None, True)}


def test_directory_splits(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(200)])
    slots, index, _ = build_index(hashed(docs.select("doc_id", "text"), 60), 10)
    held = defaultdict(int)
    for r in index.collect():
        held[r.bucket, r.depth] += 1
    assert max(held.values()) <= 10 and len(held) > 20 and len({d for _, d in held}) > 1
    assert sum(2.0 ** -d for _, d in held) <= 1


def test_copies_are_found_in_the_chains_of_the_index(spark):
    docs = docs_of(spark, TEXTS + [f"t{i % 30}" for i in range(90)])
    want = {}
    for i, keep, n, _, sha in exact_brute([(r.doc_id, r.text) for r in docs.collect()]):
        want[sha] = (keep, n)
    for bits in (2, 60):
        slots, index, _ = build_index(hashed(docs.select("doc_id", "text"), bits), 4)
        rows = index.collect()
        assert {r.text_sha256: (r.keep_id, r.group_size) for r in rows} == want and len(rows) == len(want)
        chains = defaultdict(list)
        for r in rows:
            chains[r.bucket, r.key].append(r.link)
        assert all(sorted(x) == list(range(len(x))) for x in chains.values())
        assert (max(map(len, chains.values())) > 1) == (bits == 2)
        assert {r.bucket for r in rows} <= {r.bucket for r in slots.collect()}


def test_the_answer_is_what_the_stored_index_says(spark, monkeypatch):
    from siltworks.llm import exact_dedup as module

    build = module.build_index
    monkeypatch.setattr(module, "build_index", lambda *a: altered(*build(*a)))

    def altered(slots, index, parts):
        return slots, module.stored(index.withColumn("keep_id", F.lit(-7).cast("bigint")), "altered"), parts

    assert {r.keep_id for r in exact_dedup(docs_of(spark, ["a", "b", "a"])).collect()} == {-7}


def test_keep_first_returns_whole_rows(spark):
    rows = [(None, "a b", 1), (2, "a b", 2), (1, "a\t b", 3), (1, "b", 4), (None, "c", 5), (None, "c", 5), (4, None, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, at int").withColumn("key", F.lit("k"))
    got = keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.at, r.text) for r in got.collect()) == [(3, "a\t b"), (4, "b"), (5, "c"), (7, "")]
    assert keep_first(docs.limit(0)).count() == 0


def fp_brute(text, width):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_brute(rows, width=4, bits=4):
    fps = [(i, fp_brute(t, width)) for i, t in rows]
    edges = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= bits]
    root = union(edges, [i for i, _ in fps])
    return sorted((i, f"{x:016x}", root[i]) for i, x in fps)


def test_near(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(300)) for _ in range(4)]
    texts = TEXTS + ["one", "one two", "ONE two three four", "one two three four", "one  two three four five"]
    for b in base:
        for _ in range(8):
            words = b.split()
            words[rng.randrange(300)] = "zz"
            texts.append(" ".join(words))
    docs = docs_of(spark, texts)
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in near_dedup(docs).collect()) == want
    assert sorted(tuple(r) for r in near_dedup(docs, block=3).collect()) == want
    assert near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 50, 100000])
def test_links_connect_as_all_pairs_do(spark, block):
    rng = np.random.default_rng(block)
    fps = set()
    for c in rng.integers(0, 1 << 63, 20, dtype=np.uint64):
        fps.add(int(c))
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4], signed)
    edges = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4, block)
    assert union([(r.src, r.dst) for r in edges.collect()], signed) == want
    every = np.array(sorted(fps), np.uint64)
    src, dst = forest(every, np.bitwise_count(every[:, None] ^ np.array(PIVOTS, np.uint64)).astype(np.int8), 4)
    assert union(zip(src.view(np.int64).tolist(), dst.view(np.int64).tolist()), signed) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(-50, 90), rng.randint(-50, 90)) for _ in range(70)] + [(7, 7), (None, 3)]
    edges += [(500, i) for i in range(501, 560)]
    linked = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    want = union([e for e in edges if None not in e], {x for e in edges for x in e if x is not None})
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, want[x]) for x in linked)


def test_pivot_table_and_what_it_discards(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 36, 400, dtype=np.uint64)  # as in a band: 28 bits are equal
    rows = with_pivots(spark.createDataFrame([(int(x),) for x in fps], "fp bigint")).collect()
    table = coordinates(np.array([r.p0 for r in rows]), np.array([r.p1 for r in rows]))
    for x, row in zip(fps, table):
        assert row.tolist() == [(int(x) ^ p).bit_count() for p in PIVOTS]
    far = np.abs(table[:, None].astype(int) - table[None]).max(2) > 4
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    assert not (far & (apart <= 4)).any() and far[apart > 4].mean() > 0.9


def test_finer_bands_lose_no_link():
    rng = random.Random(8)
    for _ in range(200):
        mask = sum(1 << i for i in rng.sample(range(64), 28))
        while mask.bit_count() < 50:
            free = [i for i in range(64) if not mask >> i & 1]
            change = sum(1 << i for i in rng.sample(free, min(4, len(free))))
            kept = [m for m in finer(mask) if not m & change]
            assert kept and all(m & mask == mask for m in kept)
            mask = rng.choice(kept)

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from siltworks.llm import near_copies as module
from siltworks.llm import simhash
from siltworks.llm.near_copies import near_copies

DOCS = "doc_id bigint, text string"


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, at_least=0.8):
    """The least id of each connected group."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= at_least:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(map(min, groups.values()))


def planted():
    rng = random.Random(7)
    texts = []
    for n, changes in ((50, (1, 1, 2)), (100, (1, 2, 3, 4)), (300, (1, 3, 6, 9)), (1000, (5, 20, 30))):
        for _ in range(4):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
            texts.append(base)
            for k in changes:
                copy = list(base)
                for i in rng.sample(range(n), k):
                    copy[i] = f"new{rng.randint(0, 9999)}"
                texts.append(copy)
    chain = [f"c{i}" for i in range(200)]  # each links to the next, the ends don't
    for k in range(12):
        texts.append(chain[8 * k :] + [f"d{i}" for i in range(8 * k)])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate([*texts, ["short", "text"], ["Short", "text"], [], []])] + [(900, None)]


@pytest.mark.parametrize("stars", [0, 1, 2])
def test_near_copies_as_brute_force(spark, stars):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    got = near_copies(docs.selectExpr("xxhash64(doc_id) AS row", "*"), stars=stars).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.kept) == brute(rows)


def test_stage_takes_near_copies_from_0_8_on(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    assert len(want) < len(rows) - 30
    out = corpus_pipeline.without_near_copies(spark, docs.union(docs.limit(5)), "")
    assert sorted(r.doc_id for r in out.collect()) == want
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").count() == 0


def test_stage_keeps_unique_texts_without_id_or_with_one_id(spark):
    rows = [(None, "one of these has no id at all"), (None, "and this other one has none either"), (1, "a text that shares its id with another"), (1, "another text under the very same id")]
    out = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.text for r in out.collect()) == sorted(t for _, t in rows)


def test_fingerprints_and_pivots_propose(spark, monkeypatch):
    """Close copies are found by operator 6 alone, with no band of minima at all, through its pivot table."""
    rng, rows = random.Random(3), []
    for k in range(8):
        words = [f"w{rng.randrange(9999)}" for _ in range(2000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    real, signatures, tables = simhash.with_pivots, module.signature_batches, []

    def without_minima(batches, width):
        for batch in signatures(batches, width):
            i = batch.schema.get_field_index("bands")
            yield batch.set_column(i, "bands", pa.array([[]] * batch.num_rows, pa.list_(pa.int64())))

    monkeypatch.setattr(module, "signature_batches", without_minima)
    monkeypatch.setattr(simhash, "with_pivots", lambda d: tables.append(d.count()) or real(d))
    got = near_copies(spark.createDataFrame(rows, DOCS).selectExpr("xxhash64(doc_id) AS row", "*")).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(0, 16, 2))
    assert len(tables) == 1 and 8 <= tables[0] <= 16


def test_an_outsider_in_the_band_of_a_large_group(spark):
    """A group that links and texts that share its bands without linking: the same groups as by brute force."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(160)]
    texts = []
    for k in range(60):
        words = list(base)
        words[rng.randrange(160)] = f"x{k}"
        texts.append(" ".join(words))
    for k in range(12):  # about half of the shingles of the group
        texts.append(" ".join(base[:110] + [f"y{k}_{i}" for i in range(rng.randint(28, 60))]))
    rows = [(1000 + i, i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.root for r in near_copies(spark.createDataFrame(rows, "row long, doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert len({(group[i], got[i]) for i in range(len(texts))}) == len(set(group)) == len(set(got.values()))


def test_threads_do_not_delete_each_others_tables(spark):
    import threading

    from siltworks.llm.shared import scratch, stored

    inside, seen = threading.Barrier(2), []

    def work(n):
        with scratch(spark):
            inside.wait()
            one = stored(spark.range(n), "one")
            inside.wait()
            seen.append(one.count() == n)
            inside.wait()

    threads = [threading.Thread(target=work, args=(n,)) for n in (3, 5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert seen == [True, True]

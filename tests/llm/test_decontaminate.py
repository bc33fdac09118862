import random
import re
from collections import Counter

import pytest

from siltworks.llm import decontaminate as module
from siltworks.llm.decontaminate import build_index, decontaminate, item_terms, proximity_matches, rarest_of_items, term_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if n and item is not None else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "Éé", "éé", "9", "x9", "zeta", "漢字"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 4, 5, 8, 15]))) for i in range(8, 20)] + [(1, None), (2, "..."), (3, ""), (None, "a b"), (4, "not there"), (5, "zeta ZETA zeta zeta"), (5, "zeta ZETA zeta zeta")]
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "!!"), (103, "..a"), (104, "zeta " * 500), (None, "zeta zeta zeta zeta")]
    for i in range(200, 210):
        docs.append((i, f"{make(5)}, {rng.choice(items[:12])[1].upper()}! {make(5)}."))
    return docs + docs[:3], items


@pytest.mark.parametrize(("seed", "window"), [(1, 4), (2, 10)])
def test_as_brute_force(spark, seed, window):
    docs, items = tables(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS term", "2 AS pos", "3 AS w")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS term")
    got = sorted((tuple(r) for r in decontaminate(d, b, window, within=3).collect()), key=repr)
    assert [r[:6] for r in got] == brute(docs, items, window)
    assert sum(r[5] for r in got) > 5
    assert sorted((r[0], r[1], r[6]) for r in got if r[0] is not None) == sorted((i, len(words(t)), n) for (i, t), n in zip(docs, near_brute(docs, items, 3)) if i is not None)
    assert any(r[6] > 2 for r in got)


def near_brute(docs, items, within):
    counts = Counter(w for _, t in docs for w in words(t))
    out = [0] * len(docs)
    for _, v in {(i, " ".join(words(t))) for i, t in items if i is not None}:
        ranked = sorted(set(v.split()), key=lambda w: (counts[w], w))[:3]
        for k, (_, t) in enumerate(docs):
            w = words(t)
            out[k] += bool(ranked) and any(x == ranked[0] and set(ranked[1:]) <= set(w[max(0, p - within) : p + within + 1]) for p, x in enumerate(w))
    return out


def test_passes_over_the_index_change_nothing(spark, monkeypatch):
    docs, items = tables(3)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(repr, decontaminate(d, b).collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 7)
    assert sorted(map(repr, decontaminate(d, b).collect())) == want


def test_texts_with_one_id_are_judged_each(spark):
    d = spark.createDataFrame([(1, "x one two three"), (1, "nothing here"), (None, "one two three"), (None, None), (2, "one " * 30000)], "doc_id bigint, text string")
    b = spark.createDataFrame([(5, "one two three"), (6, "one")], "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in decontaminate(d, b).collect())
    assert got == [("1", 2, 0, []), ("1", 4, 3, ["5", "6"]), ("2", 30000, 30000, ["6"]), ("None", 0, 0, []), ("None", 3, 3, ["5", "6"])]


def test_empty_tables(spark):
    docs, items = tables(1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate(d.limit(0), b).count() == 0
    assert [r for r in decontaminate(d, b.limit(0)).collect() if r.contaminated] == []


def test_proximity(spark):
    docs = [(1, "red x x fox x x jumps"), (2, "fox red jumps"), (3, "red fox"), (4, "jumps " + "x " * 30 + "red fox"), (5, None)]
    b = spark.createDataFrame([(7, "Red fox jumps"), (8, "fox"), (9, "fox unicorn")], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    index, terms = build_index(d), item_terms(b)
    got = {(r.doc_id, r.item_id) for r in proximity_matches(index, rarest_of_items(term_counts(index, terms), terms, 3), within=6).collect()}
    assert got == {(1, 7), (2, 7), (1, 8), (2, 8), (3, 8), (4, 8)}

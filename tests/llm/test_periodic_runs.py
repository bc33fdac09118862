import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from siltworks.llm import periodic_runs as P
from siltworks.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, size = i - q, j - i + q
            if size >= max(least, times * q) and not any(all(w[k] == w[k - d] for k in range(start + d, j)) for d in range(1, q)):
                out.append((start, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_of_repeats(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 12))]
        words += base * rng.randint(1, 5) + base[: rng.randint(0, len(base))]
    return [w.encode() for w in words]


@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (6, 3), (9, 2), (5, 4)])
def test_runs_as_by_definition(least, times):
    rng = random.Random(least * times)
    for _ in range(400):
        texts = [made_of_repeats(rng) for _ in range(4)]
        assert P.runs_of(texts, least, times) == [by_definition(w, least, times) for w in texts]


def test_repetitions_need_no_stretches():
    rng = random.Random(5)
    for _ in range(300):
        w = made_of_repeats(rng)
        assert sorted(P.repetitions(w, 6, 2), key=lambda r: (r[0], r[2])) == by_definition(w, 6, 2)


def test_long_texts():
    rng = random.Random(6)
    one = [b"x"] * 60000
    assert P.runs_of([one]) == [[(0, 60000, 1)]]
    base = [str(rng.random()).encode() for _ in range(9000)]
    assert P.runs_of([base * 4 + base[:7]]) == [[(0, 36007, 9000)]]
    fib, before = [b"a", b"b"], [b"a"]
    while len(fib) < 1500:
        fib, before = fib + before, fib
    assert P.runs_of([fib]) == [by_definition(fib, 24, 3)]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, gone = by_definition(words, 24, 3), set()
    for start, size, period in runs:
        gone.update(range(start + period, start + size))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_on_edges(spark, tmp_path):
    rng = random.Random(7)
    line = "the same line again and again "
    texts = [None, "", " \n\t ", "one", line * 5, "a " * 24, "a " * 23, ("x y " * 12 + "z ") * 4, "a\x0bb\x0cc d e " * 9, "  lead " + line * 9 + "\r\n" + "b " * 30, "\x1c".join("ab") * 3]
    rows = [(k, rng.choice(texts) if k % 3 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))), "t") for k in range(150)] + [(None, "a " * 30, "t"), (5, line * 7, "t"), (5, line * 7, "t")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("256")} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(*r[:2])) for r in rows)
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert sum(r.n_runs > 0 for r in got) > len(docs) // 20
    for r in got:
        assert tuple(r) == expected(r.doc_id, docs[r.doc_id])

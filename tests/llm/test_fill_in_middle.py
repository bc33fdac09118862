import hashlib
import re

from pyspark.sql import functions as F

from siltworks.llm import fill_in_middle, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = [None, "", " ", "word", "two words", "line\nbreak\r\n\ttab", "é漢字🙂👩‍👩‍👧 a🙂b", "$1 \\ {2} (x) [y] $& \\E", "has <P> in it", "has <S>", "<M>", "ends <", "S> starts", "<S", "P><", "<<<>>>", "a<P", "\u0000nul\u0000", "é   \u0085", "1" * 300, "ab " * 70000, "x" * 200000, ". " * 150000]


def expected(doc_id, text, seed=1):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_outputs_and_texts_as_by_definition(spark):
    rows = [(k * len(TEXTS) + i, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (-7, "minus"), (3, "a b"), (3, "a b"), (3, "another")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, output string")
    out = fill_in_middle.fill_in_middle(docs)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(expected(i, t)) for i, t in rows)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_other_shares(spark):
    docs = spark.createDataFrame([(k, "some words to move") for k in range(200)], "doc_id long, text string")
    forms = lambda **x: {r.form for r in fill_in_middle.fill_in_middle(docs, **x).collect()}
    assert forms(plain_from=0) == {"plain"}
    assert forms(plain_from=100, spm_below=100) == {"spm"}
    assert forms(plain_from=100, spm_below=0) == {"psm"}


def test_query_digests_and_empty_tables(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((*expected(i, t)[:5], sha(expected(i, t)[5]), sha(t or "")) for i, t in rows)
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        want = expected(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*want[1:5], hashlib.sha256(want[5].encode()).hexdigest())

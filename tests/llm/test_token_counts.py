import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from siltworks.llm import queries, token_counts

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TEXTS = ["", " ", "\n\n", "a", " a ", "It's we'll I'VE don't 'S 's", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>c", "<|end oftext|>", "<|endoftext|", "1234 5 a1b2c3 ½ Ⅷ٣", "é áb ́x 1́ ≠ ≮ ", "漢字かな交じり文 한국어", "🙂🙂👩‍👩‍👧", "a\x85b\xa0c d\x1ce", "\x00\x01", "ΣΑΣ ΟΔΟΣ İ ẞ ﬁ", "각", "x" * 9000, "7" * 9000, "ab1" * 4000, "é" * 5000, "a." * 5000, "word " * 20000, "<|endoftext|>" * 700, "12<|endoftext|>34" * 700]


def counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    model = tokenizers.Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def mixed(n, seed):
    rng = random.Random(seed)
    pool = list("aab stmdre''' \n\t  !.1é漢½🙂  ̸́=<|>09") + ["'ll", "'s", "<|endoftext|>", " ", "ͅ"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("name", NAMES)
def test_counts_as_the_library(name, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 40)
    texts = TEXTS + mixed(1500, 3)
    assert token_counts.Counter(public_tokenizers.path(name))([t.encode() for t in texts]) == counts(name, texts)


def test_where_a_text_may_be_cut():
    assert [token_counts.boundaries(public_tokenizers.path(n)) for n in NAMES] == [(True, True), (False, False), (False, False)]


def test_every_code_point_between_spaces_and_digits(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 1)
    texts = [" ".join(f"a{chr(c)} {chr(c)}1{chr(c)}2a" for c in range(lo, lo + 2048) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 2048)]
    assert token_counts.Counter(public_tokenizers.path(NAMES[0]))([t.encode() for t in texts]) == counts(NAMES[0], texts)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    count, texts = token_counts.Counter(public_tokenizers.path(NAMES[0])), mixed(300, 4)
    assert [count([t.encode()])[0] for t in texts] == counts(NAMES[0], texts)


def test_query(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, None, "x"), (3, "a b", "x"), (3, "a b", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_counts(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    n = counts(NAMES[0], [t or "" for _, t, _ in rows])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, len((t or "").encode()), k, k > 2048)) for (i, t, _), k in zip(rows, n))
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path(NAMES[0])).count() == 0


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip(docs, counts(NAMES[0], docs.values())))

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siltworks.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "  ", "\n", " \n ", "a", " a", "  a", "\na", "\n a", " \na", "a  ", "it's I'll we've you're he'd I'm don't", "'s", " 's", "!'s", "'street 'llama 'rexx", "a's't'd", "\n'll", "  'll", "''s", "x'", "x'r", "x'l", "<|endoftext|>", "1a1 a1!?", "né ñ ä b　c ", "٣४ Ⅷ ½ 漢字かな 한국어 🙂🙂 👩‍👩‍👧", "\x1c\x1d a\x85b", "é ́", "a" * 3000, "é" * 1500, "=" * 2000, " " * 999, "'" * 99, "word " * 20000]


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = list("aab stmdrevl''' \n\t  !.1é漢½🙂  ") + ["'ll", "'re", "'s", "  "]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ids_as_the_library(seed):
    texts = TEXTS + random_texts(1500, seed)
    for text, ids in zip(texts, bpe.Encoder(PATH)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == TRUE.encode_ordinary(text), text[:90]


def test_every_code_point():
    texts = [" ".join(f"a{chr(c)}{chr(c)}'" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x32000, 4096)]
    for text, ids in zip(texts, bpe.Encoder(PATH)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == TRUE.encode_ordinary(text)


def test_every_code_point_after_a_mark_a_digit_and_a_space():
    texts = ["".join(f"a {chr(c)}1{chr(c)}'{chr(c)}a" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 4096)]
    encode = bpe.Encoder(PATH)
    for text in texts:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == TRUE.encode_ordinary(text)


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    encode, texts = bpe.Encoder(PATH), random_texts(3000, 4) + ["z" * 5000, " " + "é" * 4000]
    for text in texts:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == TRUE.encode_ordinary(text)
        held = [*encode.seen.items(), *encode.older.items()]
        assert sum(bpe.ENTRY_BYTES + len(k) + len(v) for k, v in held) <= 20_000 and max((len(k) for k, _ in held), default=0) <= bpe.CACHED_PIECE


def test_round_trip(spark, monkeypatch):
    texts = TEXTS + random_texts(300, 9)
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (0, TEXTS[0])], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS offsets")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) // 4 == len(TRUE.encode_ordinary(text))
    offsets = bpe.encode(docs.filter("doc_id = 12"), PATH).first().offsets
    sizes = [len(TRUE.decode_single_token_bytes(t)) for t in TRUE.encode_ordinary(texts[12])]
    assert np.frombuffer(offsets, "<i4").tolist() == [sum(sizes[:i]) for i in range(len(sizes))]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    columns = ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(map(repr, bpe.round_trip(docs, PATH).select(columns).collect())) == sorted(map(repr, bpe.decode(bpe.encode(docs, PATH), PATH).select(columns).collect()))

"""Numbers of tokens of whole texts, by batch encoding that keeps the lengths alone."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are counted together, of strings that the library encodes in one call, and of counts that a worker remembers.
CHUNK, CALL, CACHE_BYTES = 1 << 20, 1 << 16, 64 << 20
#: A stretch without white space that is longer than this is cut at digits, and its count is not remembered.
LONG = 4096
DIGIT = re.compile(rb"(?<=[0-9])|(?=[0-9])")


def boundaries(path: str) -> tuple[bool, bool]:
    """Whether no token crosses ASCII white space, and whether each digit is a token's whole piece: where both sides of a cut count as the whole does.

    Both hold for a vocabulary that keeps the matches of a pattern, drops all else, and whose pattern and special tokens have no white space and no longer
    number. Other vocabularies (those that keep white space, and sentencepiece's) have texts counted whole.
    """
    if not path.endswith(".json"):
        return False, False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    first = (kind.get("pretokenizers") or [kind])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    special = "".join(t["content"] for t in spec.get("added_tokens", []))
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" not in pattern.replace("[^\\s", "") and " " not in pattern
    spaces = bool(drops) and not any(c.isspace() for c in special)
    return spaces, spaces and "|[\\p{N}]|" in pattern and not any(c.isdigit() for c in special)


class Counter:
    """Counts tokens of UTF-8 texts. A worker makes one and keeps it, with the counts of the stretches between white space it has met."""

    def __init__(self, path: str):
        self.at_spaces, self.at_digits = boundaries(path)
        self.seen: dict[bytes, int] = {}
        self.room = CACHE_BYTES
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[bytes]) -> list[int]:
        """Of each text by the library, in calls of about equal bytes: the longest first, so that a call's texts are alike."""
        out, call, size = [0] * len(texts), [], 0
        for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
            call.append(k)
            size += len(texts[k])
            if size >= CALL:
                self._call(texts, call, out)
                call, size = [], 0
        self._call(texts, call, out)
        return out

    def _call(self, texts, call, out) -> None:
        if call:
            for k, n in zip(call, self.encode([texts[k].decode(errors="replace") for k in call])):
                out[k] = n

    def __call__(self, texts: list[bytes]) -> list[int]:
        if not self.at_spaces:
            return self.whole(texts)
        split = [t.split() for t in texts]  # bytes are split at ASCII white space alone
        new = set().union(*split).difference(self.seen)
        long = [x for x in new if len(x) > LONG]
        short = list(new.difference(long))
        if self.room < 0:
            self.seen, self.room = {}, CACHE_BYTES
            short = list(set().union(*split).difference(long))
        self.seen.update(zip(short, self.whole(short)))
        self.room -= sum(map(len, short)) + 120 * len(short)
        for x in long:
            self.seen[x] = sum(self.whole(DIGIT.split(x) if self.at_digits else [x]))
        out = [sum(map(self.seen.__getitem__, s)) for s in split]
        for x in long:
            del self.seen[x]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        counts, texts, n = [], [], 0
        for text in batch.column(1):
            text = text.as_py() or b""
            texts.append(text)
            n += len(text)
            if n >= CHUNK:
                counts += count(texts)
                texts, n = [], 0
        counts += count(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    ``path``: a vocabulary file on each executor, of ``tokenizers`` (.json) or ``sentencepiece`` (.model). Counts are those of the library without begin,
    end or added special tokens, truncation or padding; the strings of special tokens inside a text are what the library makes of them by default. Texts are
    whole: a long one is cut only where no token can cross (see ``boundaries``) and its parts' counts are added. A null text is empty and has no
    tokens. Rows stay in place, repeated rows and null ids too; nothing is shuffled. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(lambda it: count_batches(it, path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

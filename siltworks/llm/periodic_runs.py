"""Stretches of words that repeat with a period, found by a suffix automaton, and texts with one period of each left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose word sequences are compared together.
CHUNK = 2 << 20

Run = tuple[int, int, int]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of each prefix) of the suffix automaton: the links are a tree whose root is state 0."""
    after: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for i, c in enumerate(words):
        new, p = len(after), last
        after.append({})
        length.append(i + 1)
        link.append(0)
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] > length[p] + 1:
                split = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = split
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = split
                    p = link[p]
                q = split
            link[new] = q
        ends.append(new)
        last = new
    return link, length, ends


def heavy_paths(link: list[int], length: list[int]) -> list[int]:
    """The top of each state's heavy path: a path goes on to the child with most states below it, so any way up crosses few paths."""
    order = np.argsort(length, kind="stable").tolist()
    below, heavy, most = [1] * len(link), [-1] * len(link), [0] * len(link)
    for v in reversed(order):
        p = link[v]
        if p >= 0:
            below[p] += below[v]
            if below[v] > most[p]:
                most[p], heavy[p] = below[v], v
    top = [0] * len(link)
    for v in order:
        p = link[v]
        top[v] = top[p] if p >= 0 and heavy[p] == v else v
    return top


def repetitions(words: list[int], least: int, times: int) -> set[Run]:
    """(start, length, period) of the maximal repetitions of at least ``times`` periods and ``least`` words.

    A state of the link tree is coloured with the last place where its words ended. Appending word i is an access to its prefix's state: the way from it to the
    root falls into segments of one colour, which all turn to i. Where the longest words of a segment that ended at e last are at least as many as i - e, two copies of a
    square end here. Colours on a heavy path are a stack of (length down to which, end), nearest to the root last, so an access pops what it recolours.
    """
    link, length, ends = automaton(words)
    top = heavy_paths(link, length)
    stacks: list[list[tuple[int, int]]] = [[] for _ in link]
    found, n, more = set(), len(words), times - 1
    for i, state in enumerate(ends):
        before = -1
        while state >= 0:
            head, deep, popped = top[state], length[state], -1
            stack = stacks[head]
            parts = []
            while stack and stack[-1][0] <= deep:
                parts.append(stack.pop())
                popped = parts[-1][0]
            if stack and popped < deep:
                parts.append((deep, stack[-1][1]))
            stack.append((deep, i))
            for long, end in reversed(parts):  # from the deepest up; of one colour the deepest says all
                if end != before:
                    before, period = end, i - end
                    if long >= more * period and long + period >= least and (i + 1 == n or words[i + 1] != words[end + 1]):
                        found.add((end - long + 1, long + period, period))
            state = link[head]
    return found


def stretches(codes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(text, from, to) of parts outside of which no repetition can be, from word codes of texts one after another.

    A repetition of period q has each gram but those of its first q words a second time, q words before. So parts are sought where many grams in a row have
    stood before within a ``times``th of the text. Equal words have equal codes, so codes of different words that agree only make parts larger.
    """
    rest = least - least // times
    width = max(1, rest // 2)
    need = rest - width + 1
    if len(codes) < width:
        return []
    grams = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + len(grams)] ^ np.uint64(k + 1))
        grams ^= grams >> np.uint64(29)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(grams)] == text[width - 1 :]
    at = np.flatnonzero(whole)
    key = grams[at] + text[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    one, two = at[order[:-1]][same], at[order[1:]][same]
    two = two[(text[one] == text[two]) & ((two - one) * times <= sizes[text[two]])]
    if not len(two):
        return []
    two.sort()
    breaks = np.flatnonzero((np.diff(two) > 1) | (np.diff(text[two]) > 0))
    first, last = two[np.append(0, breaks + 1)], two[np.append(breaks, len(two) - 1)]
    out: list[tuple[int, int, int]] = []
    for x, y in zip(first.tolist(), last.tolist()):
        if y - x + 1 >= need:
            t = int(text[x])
            a, b = max(0, x - (y - x + width) // (times - 1) - int(starts[t])), y + width - int(starts[t])
            while out and out[-1][0] == t and out[-1][2] >= a:
                _, a0, b0 = out.pop()
                a, b = min(a, a0), max(b, b0)
            out.append((t, a, b))
    return out


def runs_of(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[Run]]:
    """The runs of each text, given as its words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    found: list[set[Run]] = [set() for _ in texts]
    for t, a, b in stretches(codes, sizes, least, times):
        words, ids = texts[t], {}
        for start, size, period in repetitions([ids.setdefault(w, len(ids)) for w in words[a:b]], least, times):
            lo, hi = a + start, a + start + size
            while lo and words[lo - 1] == words[lo - 1 + period]:
                lo -= 1
            while hi < len(words) and words[hi] == words[hi - period]:
                hi += 1
            found[t].add((lo, hi - lo, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by spaces, of each run the first period alone."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, size, period in runs:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_batches(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    def flush(ids, texts):
        words = [t.split() for t in texts]  # bytes are split at ASCII white space alone
        runs = runs_of(words, least, times)
        listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(_RUN))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), listed, pa.array(map(collapse, words, runs), pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        ids, texts, n = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or b""
            ids.append(i)
            texts.append(text)
            n += len(text)
            if n >= CHUNK:
                yield flush(ids, texts)
                ids, texts, n = [], [], 0
        if ids:
            yield flush(ids, texts)


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    A word is what stands between ASCII white space. A run is a stretch of words with smallest period q (words q apart are equal) of at least ``least`` words
    and ``times`` periods that no neighbouring word extends. ``collapsed`` has the words joined by one space, of each run the first period alone; words that
    another run drops stay dropped. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows and null ids stay; only doc_id
    and text are read. A task holds one text at a time beyond ``CHUNK`` bytes; nothing is shuffled.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(lambda it: find_batches(it, least, times), "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))

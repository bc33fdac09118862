"""Operator 5, quality classifier: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.labelled import held_out, labelled_sample

#: Characters that are handled at once.
CHUNK = 1 << 20
N_OWN = 18
_CLASS = np.zeros(128, np.uint8)  # of ASCII: 0 other symbol, 1 upper, 2 lower, 3 digit, 4 space, 5 punctuation, 6 ! or ?
for _chars, _kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), (".,;:'\"()-", 5), ("!?", 6)):
    _CLASS[[ord(c) for c in _chars]] = _kind


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths of the lines in characters, number of lines of each text). A text without characters is one empty line."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lines = [x for s in split for x in s]
    length = np.array([len(x) for x in lines])
    points = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(points < 128, _CLASS[np.minimum(points, 127)], 7)
    starts = np.cumsum(length + 1) - length - 1
    kind[starts + length] = 8  # the line's end
    # how many characters of each kind: one bin for each line and kind
    owner = np.repeat(np.arange(len(lines)), length + 1)
    share = np.bincount(owner * 9 + kind, minlength=9 * len(lines)).reshape(-1, 9)[:, :8] / np.maximum(1, length)[:, None]
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words]) / np.maximum(1, n_words)
    repeated = np.fromiter((y for s in split for y in _repeats(s)), float, len(lines))
    last = np.where(length > 0, kind[starts + np.maximum(0, length - 1)], 8)
    first = kind[starts]
    many = n_words >= 8
    x = np.column_stack([
        np.log1p(length), np.log1p(n_words), share, distinct, many & (distinct < 0.5), share[:, 1] > 0.5, share[:, 0] > 0.03, repeated,
        last == 5, first == 1, np.minimum(30, length / np.maximum(1, n_words)) / 10,
    ])
    # neighbours: the same features of the line before and the line after, nothing beyond the text
    ends = np.cumsum(counts)
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[ends - counts], after[ends - 1] = 0, 0
    edges = np.zeros((len(lines), 2))
    edges[ends - counts, 0], edges[ends - 1, 1] = 1, 1
    return np.column_stack([x, before, after, edges]), length, counts


def features_in_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of all texts, made for ``CHUNK`` characters at a time, as the work on characters takes some thirty times their bytes."""
    parts, lo, n = [], 0, 0
    for hi, text in enumerate(texts, 1):
        n += len(text)
        if n >= CHUNK or hi == len(texts):
            parts.append(line_features(texts[lo:hi]))
            lo, n = hi, 0
    return tuple(np.concatenate(x) for x in zip(*parts))


def _repeats(lines: list[str]):
    seen = set()
    for x in lines:
        yield float(bool(x) and x in seen)
        seen.add(x)


def forward_backward(unary: np.ndarray, counts: np.ndarray, change: np.ndarray, pairs: bool = False):
    """Probability of good for each line of chains of ``counts`` lines; with ``pairs``, also of each transition: (line that it leads to, 2x2).

    ``unary``: score of good over bad for each line. ``change``: scores of the transitions. All chains advance a line at a time, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    start, n = (np.cumsum(counts) - counts)[order], counts[order]
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    score = np.column_stack([np.zeros(len(unary)), unary])
    active = np.searchsorted(-n, -np.arange(n[0]), "left")  # chains of over t lines
    alpha[start] = score[start]
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        alpha[at] = score[at] + np.logaddexp(alpha[at - 1, :1] + change[0], alpha[at - 1, 1:] + change[1])
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        ahead = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(change[:, 0] + ahead[:, :1], change[:, 1] + ahead[:, 1:])
    total = np.empty(len(counts))
    total[order] = np.logaddexp(*alpha[start + n - 1].T)
    logz = np.repeat(total, counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - logz)
    if not pairs:
        return good
    inner = np.ones(len(unary), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    return good, at, np.exp(alpha[at - 1][:, :, None] + change + (score[at] + beta[at])[:, None, :] - logz[at][:, None, None])


@dataclass(frozen=True)
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias
    change: np.ndarray  # transition scores, from row to column, bad first
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def evidence(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each text."""
        unary = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        good = forward_backward(unary, counts, self.change)
        at, weight = np.cumsum(counts) - counts, length + 1.0
        p = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(*line_features(texts)) + self.shift)))


def fit_crf(texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam; every line carries its document's label. ``weights``: of each document.

    The likelihood counts each document once, however many lines it has. A logistic calibration of the documents' log odds follows.
    """
    x, length, counts = features_in_parts(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    y = np.repeat(labels, counts).astype(float)
    by = weights / weights.sum() / counts
    row = np.repeat(by, counts)
    w, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(len(w) + 4) for _ in range(2)]
    # observed transitions all stay within one label
    stays = np.diag([(by * (counts - 1) * (labels == k)).sum() for k in (0, 1)])
    for step in range(1, steps + 1):
        good, at, pairs = forward_backward(x @ w, counts, change, True)
        expected = np.tensordot(row[at], pairs, 1)
        gradient = np.concatenate([x.T @ (row * (y - good)) - penalty * w, (stays - expected).ravel() - penalty * change.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, change = w + move[:-4], np.clip(change + move[-4:].reshape(2, 2), -4, 4)
    crf = Crf(mean, scale, w, change)
    z = crf.evidence(x[:, :-1] * scale + mean, length, counts)
    slope, shift = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        e = weights / weights.sum() * (labels - p)
        slope, shift = max(0.05, slope + 0.05 * ((e * z).sum() - 0.01 * slope)), shift + 0.2 * e.sum()
    return Crf(mean, scale, w, change, slope, shift)


def score_batches(batches: Iterator[pa.RecordBatch], crf: Crf, keep: float | None) -> Iterator[pa.RecordBatch]:
    """A column score; with ``keep``, instead only the rows with at least that score. The text is the second column of each batch."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, n = lo, 0
            while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= CHUNK):
                n += len(texts[hi] or "")
                hi += 1
            score = pa.array(crf.scores([x or "" for x in texts[lo:hi]]))
            part = batch.slice(lo, hi - lo)
            lo = hi
            if keep is None:
                yield pa.RecordBatch.from_arrays([part.column(0), score], ["doc_id", "score"])
            else:
                yield part.filter(pa.compute.greater_equal(score, keep))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Crf:
    """Learn from at most ``most`` labelled documents of each class, weighted to the classes' shares; where a class has none, all scores are 0.5 or above.

    That is the only bound: what is scored is every row and whole text.
    """
    rows = labelled_sample(docs, labels, "quality", (most, most)).select("text", "label").collect()  # 2 * most texts at most
    y = np.array([r.label for r in rows], int)
    if len(set(y.tolist())) < 2:
        width = 3 * N_OWN + 2
        return Crf(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))
    known = labels.filter(F.col("quality").isNotNull() & ~held_out())
    share = dict(known.groupBy(F.col("quality").cast("int")).count().collect())
    weights = np.array([share[k] / (y == k).sum() for k in y])
    return fit_crf([r.text or "" for r in rows], y, weights)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 2000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better), predicted (1 from ``threshold`` on).

    A null or empty text is scored as one empty line. Repeated rows get the same score. Labels without a quality don't count; of several for
    a document the highest does. Scores come from the text alone; other columns are not read.
    """
    crf = fit_quality(docs, labels, most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lambda it: score_batches(it, crf, None), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 2000) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    crf = fit_quality(docs, labels, most)
    first = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = first.mapInArrow(lambda it: score_batches(it, crf, threshold), first.schema)
    return kept.select(docs.columns)

"""Operator 2, toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.labelled import labelled_sample

WORD = re.compile(r"[^\W_]+")
#: Grades of severity: 0 clean, 1 to 3 by how many of its words are telling in other toxic texts (see ``severity_grades``).
GRADES = 4
#: Length of the word beginnings that are features beside whole words: they carry over to other endings.
STEMS = (4, 5)


def features(text: str) -> Counter:
    """How often each lower-case word and word beginning (marked by '*') occurs."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


@dataclass(frozen=True)
class Ordinal:
    """P(grade >= k) = logistic(w.x - cut[k - 1]): one weight vector for all ordered cuts."""

    weights: dict[str, float]
    cuts: np.ndarray
    threshold: float = 0.5  # of P(grade >= 1)

    def at_least(self, texts: list[str]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        score = np.array([self.score(t) for t in texts])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))

    def score(self, text: str) -> float:
        total, get, words = 0.0, self.weights.get, Counter(WORD.findall(text.lower()))
        for word, n in words.items():
            v = np.log1p(n) if n > 1 else LN2
            if w := get(word):
                total += w * v
            for k in STEMS:
                if len(word) > k and (w := get(word[:k] + "*")):
                    total += w * v
        return total


LN2 = float(np.log(2))


def telling(bags: list[Counter], bad: np.ndarray, least_df: int, least_chi2: float) -> set[str]:
    """Features of at least ``least_df`` texts that the bad texts have more often, by a chi-squared of ``least_chi2`` (25: five deviations)."""
    df, df_bad = Counter(), Counter()
    for bag, b in zip(bags, bad):
        df.update(bag.keys())
        if b:
            df_bad.update(bag.keys())
    n, m = len(bags), int(bad.sum())
    return {f for f, k in df.items() if k >= least_df and (d := df_bad[f] * n - k * m) > 0 and n * d * d >= least_chi2 * k * m * (n - k) * (n - m)}


def severity_grades(bags: list[Counter], toxic: np.ndarray, names: set[str]) -> np.ndarray:
    """Grades 0 to 3 from 0/1 labels: clean texts 0; toxic ones by how many of their words are telling: thirds of the toxic texts, ties in the lower."""
    count = np.array([sum(n for f, n in bag.items() if f in names and f[-1] != "*") for bag in bags])
    cuts = np.quantile(count[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 0, 0, 1 + (count > cuts[0]) + (count > cuts[1]))


def cross_fitted_grades(texts: list[str], bags: list[Counter], toxic: np.ndarray, least_df: int, least_chi2: float) -> np.ndarray:
    """Severity grades of each half of the texts by the words that are telling in the other half, so that no text helps to choose the words it is graded by.

    The labels have two classes only: a grade above 0 says how much of the wording of other toxic texts a text repeats, no more.
    """
    half, out = np.array([crc32(t.encode("utf-8", "replace")) % 2 for t in texts]), np.zeros(len(texts), int)
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if not toxic[own].any() or len(set(toxic[other].tolist())) < 2:
            return severity_grades(bags, toxic, telling(bags, toxic, least_df, least_chi2))
        out[own] = severity_grades([bags[i] for i in own], toxic[own], telling([bags[i] for i in other], toxic[other], least_df, least_chi2))
    return out


def fit_ordinal(bags: list[Counter], grades: np.ndarray, names: set[str], steps: int = 400, penalty: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam over the features ``names``. The cuts stay ordered by positive steps. Weights under 0.3, which add up in long texts, are dropped."""
    names = sorted(names)
    index = {f: i for i, f in enumerate(names)}
    row = np.array([i for i, b in enumerate(bags) for f in b if f in index], int)
    column = np.array([index[f] for b in bags for f in b if f in index], int)
    value = np.log1p([float(c) for b in bags for f, c in b.items() if f in index])
    share = np.full(len(bags), 1 / len(bags))
    w, cut = np.zeros(len(names)), np.array([1.0, 0.0, 0.0])  # the first cut and the logs of the steps
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for step in range(1, steps + 1):
        score = np.bincount(row, value * w[column], len(bags))
        theta = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        # P(y = k) = S_k - S_{k+1} with S_0 = 1 and S_4 = 0
        s = np.column_stack([np.ones(len(bags)), 1 / (1 + np.exp(np.clip(theta - score[:, None], -60, 60))), np.zeros(len(bags))])
        slope = s * (1 - s)
        at = np.arange(len(bags)), grades
        p = np.maximum(s[at] - s[at[0], grades + 1], 1e-12)
        by_score = share * (slope[at] - slope[at[0], grades + 1]) / p
        by_theta = np.zeros_like(theta)
        for k in range(1, GRADES):  # S_k appears in P(y = k) and, negatively, in P(y = k - 1)
            by_theta[k - 1] = (share * slope[:, k] / p * ((grades == k - 1).astype(float) - (grades == k))).sum()
        by_cut = np.array([by_theta.sum(), by_theta[1:].sum() * np.exp(cut[1]), by_theta[2:].sum() * np.exp(cut[2])])
        gradient = np.concatenate([np.bincount(column, value * by_score[row], len(w)) - penalty * w, by_cut])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, cut = w + move[:-3], cut + move[-3:]
    return Ordinal({f: float(x) for f, x in zip(names, w) if abs(x) >= 0.3}, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))]))


def fit_texts(texts: list[str], toxic: np.ndarray, least_df: int = 3, least_chi2: float = 40.0) -> Ordinal:
    bags = [features(t) for t in texts]
    names = telling(bags, toxic, least_df, least_chi2)
    model = fit_ordinal(bags, cross_fitted_grades(texts, bags, toxic, least_df, least_chi2), names)
    # the threshold with the best mean accuracy of both classes, amid equals; a word more or less decides, so not above 1/2
    p = model.at_least(texts)[:, 0]
    tried = np.linspace(0.2, 0.5, 31)
    right = np.array([(p[toxic == 1] >= t).mean() + (p[toxic == 0] < t).mean() for t in tried])
    return replace(model, threshold=float(np.median(tried[right >= right.max() - 1e-9])))


def severity_batches(batches: Iterator[pa.RecordBatch], model: Ordinal) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            s = model.at_least([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.sum(1)), pa.array(s[:, 0]), pa.array((s >= 0.5).sum(1).astype(np.int32))], ["doc_id", "severity", "p_toxic", "grade"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Ordinal:
    """Learn from at most ``most`` toxic and three times as many clean labelled documents. Without both classes all texts are clean."""
    rows = labelled_sample(docs, labels, "toxic", (3 * most, most)).select("text", "label").collect()  # 4 * most texts at most
    texts, y = [r.text or "" for r in rows], np.array([r.label for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Ordinal({}, np.array([9.0, 10.0, 11.0]))
    return fit_texts(texts, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 2000) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade, 0 to 3), p_toxic (that of grade 1 or more), grade (median), toxic (p_toxic from the fitted threshold on).

    The labels have two classes; the grades above 0 are thirds of the toxic texts by their number of words that are telling in the other half of the texts. The
    sample for fitting is bounded by ``most``; whole texts of all rows are scored. A null or empty text has no features. Repeated
    rows get the same answer. Only doc_id and text are read.
    """
    model = fit_toxicity(docs, labels, most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lambda it: severity_batches(it, model), "doc_id bigint, severity double, p_toxic double, grade int")
    return scored.withColumn("toxic", F.col("p_toxic") >= model.threshold)

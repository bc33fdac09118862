import itertools

import numpy as np
import pytest

import corpus_pipeline
from siltworks.llm import quality
from siltworks.llm.queries import QUERIES, table
from siltworks.llm.quality import forward_backward, score_quality
from siltworks.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_as_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 6, 2])
    unary, change = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, at, pairs = forward_backward(unary, counts, change, True)
    start = 0
    for n in counts:
        u = unary[start : start + n]
        of = {y: np.exp(sum(u[i] * y[i] for i in range(n)) + sum(change[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(of.values())
        for i in range(n):
            assert good[start + i] == pytest.approx(sum(v for y, v in of.items() if y[i]) / z)
            if i:
                assert pairs[at.tolist().index(start + i)][0, 1] == pytest.approx(sum(v for y, v in of.items() if (y[i - 1], y[i]) == (0, 1)) / z)
        start += n


@pytest.mark.parametrize(("score", "label", "answer"), [(score_quality, "quality", lambda r: r.predicted), (score_toxicity, "toxic", lambda r: int(r.toxic))])
def test_held_out_accuracy(spark, score, label, answer):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: answer(r) for r in score(docs, labels).filter("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    pairs = [(got[r.doc_id], r[label]) for r in labels.collect() if r.doc_id in got]
    assert len(pairs) > 50 and np.mean([a == b for a, b in pairs]) > 0.9


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_edges(spark, score):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (None, "x"), (3, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS label")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 1, 1), (None, 0, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert score(docs, known).count() == 5
    assert score(docs.limit(0), labels).count() == 0


def test_pipeline_keeps_all_columns_and_drops_as_its_stages_say(spark):
    docs = spark.createDataFrame([(i, f"This is a plain sentence number {i} about the weather in town, and more of it." * 3, "en", "s", 9) for i in range(6)] + [(10, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.union(docs.filter("doc_id < 2")).union(docs.filter("doc_id = 3").selectExpr("doc_id + 50", "replace(text, ' ', '  ')", "lang", "source", "n_chars"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted(r.doc_id for r in out.collect())
        assert len(got) == len(set(got)) and (name != "exact_dedup" or got == [0, 1, 2, 3, 4, 5, 10])
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert list(QUERIES) == [n for n in QUERIES if n.startswith("op")] + ["pipeline"]


def test_ordinal_fit_is_a_maximum_and_orders_its_grades():
    from collections import Counter

    from siltworks.llm.toxicity import fit_ordinal

    rng = np.random.default_rng(2)
    bags = [Counter({w: int(n) for w, n in zip("abc", rng.integers(0, 6, 3)) if n}) for _ in range(400)]
    z = np.array([1.5 * np.log1p(b["a"]) - 0.8 * np.log1p(b["b"]) + rng.logistic() * 0.7 for b in bags])
    grades = np.searchsorted([0.3, 1.2, 2.2], z)
    model = fit_ordinal(bags, grades, {"a", "b"})
    assert model.weights["a"] > 1 > 0 > model.weights["b"] and (np.diff(model.cuts) > 0).all()

    def likelihood(w, cuts):
        score = np.array([sum(w[f] * np.log1p(n) for f, n in b.items() if f in w) for b in bags])
        s = np.column_stack([np.ones(len(bags)), 1 / (1 + np.exp(cuts - score[:, None])), np.zeros(len(bags))])
        return np.log(s[np.arange(len(bags)), grades] - s[np.arange(len(bags)), grades + 1]).mean() - 5e-5 * sum(x * x for x in w.values())

    best = likelihood(model.weights, model.cuts)
    for f in "ab":
        for step in (-0.1, 0.1):
            assert likelihood(model.weights | {f: model.weights[f] + step}, model.cuts) < best
    for i in range(3):
        for step in (-0.1, 0.1):
            assert likelihood(model.weights, model.cuts + step * (np.arange(3) == i)) < best


def test_crf_score_as_enumeration_over_lines():
    from siltworks.llm.quality import fit_crf, line_features

    texts = ["A good line of words here.\nAnother fine one follows it.", "xx!! 99\n\n%% $$", "Short one.", "zz9 ## !!\nzz9 ## !!", ""]
    crf = fit_crf(texts, np.array([1, 0, 1, 0, 0]), np.ones(5), steps=40)
    for text, score in zip(texts, crf.scores(texts)):
        x, length, _ = line_features([text])
        u = (x - crf.mean) / crf.scale @ crf.weights[:-1] + crf.weights[-1]
        n = len(u)
        of = {y: np.exp(sum(u[i] * y[i] for i in range(n)) + sum(crf.change[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        good = np.array([sum(v for y, v in of.items() if y[i]) for i in range(n)]) / sum(of.values())
        p = np.clip((good * (length + 1.0)).sum() / (length + 1.0).sum(), 1e-6, 1 - 1e-6)
        assert score == pytest.approx(1 / (1 + np.exp(-(crf.slope * np.log(p / (1 - p)) + crf.shift))))


def test_features_in_parts_are_those_of_all(monkeypatch):
    texts = ["a line\nAND ONE\n\na line", "", "x" * 500, "last one!\n"] * 9
    whole = quality.line_features(texts)
    for size in (1, 300, 10**9):
        monkeypatch.setattr(quality, "CHUNK", size)
        assert all((a == b).all() for a, b in zip(quality.features_in_parts(texts), whole))

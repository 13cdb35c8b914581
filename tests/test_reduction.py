"""Text vectors against a plain singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import reduction, topics


def corpus(seed=0, n=300):
    r = np.random.default_rng(seed)
    words = [["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(25)] for _ in range(5)]
    return [(i, " ".join(words[i % 5][k] for k in r.integers(0, 25, int(r.integers(8, 60))))) for i in range(n)]


def dense(spark, df):
    rows = reduction.slot_counts(df, T.terms(F.col("review_text"))).collect()
    a = np.zeros((len(rows), reduction.SLOTS))
    for i, r in enumerate(rows):
        a[i, r.slots] = r.counts
    df_ = (a > 0).sum(axis=0)
    w = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0) * np.where(df_ >= 2, np.log((1 + len(rows)) / (1 + df_)) + 1, 0)
    size = np.linalg.norm(w, axis=1, keepdims=True)
    return [r.key for r in rows], w / np.where(size > 0, size, 1)


@pytest.mark.parametrize("step", [64, 1 << 14])
def test_projection_captures_what_a_plain_decomposition_does(spark, monkeypatch, step):
    monkeypatch.setattr(reduction, "_STEP", step)
    df = spark.createDataFrame(corpus(), "review_id long, review_text string").repartition(4)
    keys, w = dense(spark, df)
    counted = reduction.slot_counts(df, T.terms(F.col("review_text")))
    model = reduction.fit(counted, 12)
    exact = np.linalg.svd(w, compute_uv=False)[:12]
    assert np.allclose(model.values[:5], exact[:5], rtol=1e-4)
    assert np.allclose(model.basis.T @ model.basis, np.eye(12), atol=1e-8)
    # energy that the projection keeps, against the best of the same rank; the last seven values are noise without a gap
    kept = np.linalg.norm(w @ model.basis) ** 2
    assert kept >= 0.985 * (exact**2).sum()
    got = {r.key: r.vector for r in reduction.project(counted, model).collect()}
    assert np.allclose([got[k] for k in keys], w @ model.basis, atol=1e-9)


def test_text_vectors_of_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "a an it"), (4, "unique wordings nowhere else"), (None, "shared terms here"), (5, "shared terms here"), (5, "shared terms here"), (6, "shared " * 60_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "review_id long, review_text string, vector string")
    got = sorted((r.review_id is None, r.review_id or 0, r.vector is None) for r in reduction.text_vectors(df, components=4).collect())
    assert got == [(False, 1, True), (False, 2, True), (False, 3, True), (False, 4, True), (False, 5, False), (False, 5, False), (False, 6, False), (True, 0, False)]
    assert reduction.text_vectors(df.where("false")).collect() == []


def test_topics_from_texts(spark):
    """Texts of five vocabularies are five topics, named by their own words; junk is left out."""
    data = corpus(3) + [(1000 + i, None if i % 2 else f"alone{chr(97 + i)}{chr(98 + i)}xy once") for i in range(10)]
    df = spark.createDataFrame(data, "review_id long, review_text string")
    found = topics.text_topics(df, components=8).cache()
    rows = {r.review_id: r for r in found.collect()}
    own = [[rows[i].topic_id for i in range(300) if i % 5 == k] for k in range(5)]
    assert len(rows) == 310 and {rows[1000 + i].topic_id for i in range(10)} == {-1}
    best = [max(set(t), key=t.count) for t in own]
    assert sorted(best) == [0, 1, 2, 3, 4] and all(t.count(b) >= 0.8 * len(t) for t, b in zip(own, best))
    words = topics.topic_words(topics.class_tfidf(topics.term_counts(df.join(found, "review_id"), T.terms(F.col("review_text"))))).where("topic_id >= 0").collect()
    vocabulary = [{w for i, t in data[:300] if i % 5 == k for w in t.split()} for k in range(5)]
    assert all(set(r.term.split()) <= vocabulary[best.index(r.topic_id)] for r in words)

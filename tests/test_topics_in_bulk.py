"""Perplexity of many documents at a time, and documents prepared once for all models."""

import math
import random

import pytest

from gritstone.operators import topics


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(k, [r.choice(["sun", "sea", "sand", "salt", "all"] if k % 2 else ["cat", "dog", "cow", "hen", "all"]) for _ in range(k % 40)]) for k in range(200)]
    return spark.createDataFrame(rows, "row_id long, tokens array<string>").repartition(3)


@pytest.mark.parametrize("name", ["lda_final", "lda_grid"])
def test_documents_are_prepared_once(docs, monkeypatch, name):
    prepared, whole = [], topics.weighted_counts
    monkeypatch.setattr(topics, "weighted_counts", lambda *a, **b: prepared.append(1) or whole(*a, **b))
    if name == "lda_final":
        topics.fit_until_settled(docs, 2, most=15, step=5, patience=50, min_docs=1, max_share=1.0)
    else:
        topics.lda_grid(docs, (2, 3), "row_id", iterations=5, min_docs=1, max_share=1.0)
    assert len(prepared) == 1


@pytest.mark.parametrize("k", [2, 5])
def test_perplexity_is_the_librarys(docs, k):
    model, _, weighted = topics.fit_lda(docs, k, iterations=10, min_docs=1, max_share=1.0)
    assert topics.perplexity(model, weighted) == pytest.approx(math.exp(model.logPerplexity(weighted)), rel=2e-3)

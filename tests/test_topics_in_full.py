"""Topic models that read all documents in each iteration and go on as far as the originals."""

import inspect
import random

import pytest

from gritstone.operators import topics
from gritstone.plans import topics as plans


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(k, [r.choice(["sun", "sea", "sand", "salt", "all"] if k % 2 else ["cat", "dog", "cow", "hen", "all"]) for _ in range(k % 40)]) for k in range(200)]
    return spark.createDataFrame(rows, "row_id long, tokens array<string>").repartition(3)


def called(monkeypatch, name, *args, **options):
    """The arguments a query calls the operator with, defaults included; the operator itself gets others."""
    got, whole = {}, getattr(topics, name)

    def call(*a, **b):
        bound = inspect.signature(whole).bind(*a, **b)
        bound.apply_defaults()
        got.update(bound.arguments)
        return whole(*args, **options)

    monkeypatch.setattr(topics, name, call)
    return got


def test_final_model_has_the_whole_search(spark, docs, monkeypatch):
    got = called(monkeypatch, "fit_until_settled", docs, 2, most=2, step=1, min_docs=1, max_share=1.0)
    monkeypatch.setattr(plans, "docs", lambda *_: docs)
    plans.lda_final(spark, "")
    assert (got["most"], got["step"], got["patience"]) == (1000, 50, 150)


def test_search_goes_on_with_one_model_until_patience_ends(docs, monkeypatch):
    values, fits, whole = iter([5.0, 4.0, 6.0, 3.0, 7.0, 7.0, 7.0]), [], topics.Fit.__init__
    monkeypatch.setattr(topics, "perplexity", lambda *_: next(values))
    monkeypatch.setattr(topics.Fit, "__init__", lambda self, *a, **b: fits.append(self) or whole(self, *a, **b))
    *_, iterations = topics.fit_until_settled(docs, 2, most=30, step=2, patience=6, min_docs=1, max_share=1.0)
    assert iterations == 8 and [f.sweeps for f in fits] == [14]


def test_an_iteration_takes_all_documents(docs):
    model, vocab, weighted = topics.fit_lda(docs, 2, iterations=1, min_docs=1, max_share=1.0)
    n = sum(float(sum(r["features"].values)) for r in weighted.select("features").collect())
    assert model.topicsMatrix().toArray().sum() == pytest.approx(n + len(vocab), rel=1e-5)


@pytest.mark.parametrize("width", [1, 10**6])
def test_sweeps_are_those_of_plain_loops(docs, monkeypatch, width):
    """In chunks of one document and in one chunk; both models of a fit, beside each other or alone."""
    import numpy as np

    monkeypatch.setattr(topics, "CHUNK", width)
    vocab, weighted = topics.weighted_counts(docs, min_docs=1, max_share=1.0)
    bags = topics.bags(weighted)
    both = topics.Fit(bags, len(vocab), (2, 3)).go_on(3)
    alone = topics.Fit(bags, len(vocab), (3,)).go_on(3)
    assert np.allclose(both.topics[1], alone.topics[0], rtol=1e-4) and np.allclose(both.alpha[1], alone.alpha[0], rtol=1e-5)
    counts = [(f.indices, f.values) for f in (r["features"] for r in weighted.select("features").collect()) if len(f.indices)]
    assert bags[1] == len(counts) and bags[2] == sum(len(w) for w, _ in counts)
    lam, alpha, gammas = np.random.default_rng([42, 3]).gamma(100, 1 / 100, (3, len(vocab))), np.full(3, 1 / 3), [np.ones(3)] * len(counts)
    for sweep in range(1, 4):
        beta, sums, logs = np.exp(topics._expectation(lam)), np.zeros_like(lam), np.zeros(3)
        for d, (words, n) in enumerate(counts):
            log_theta = topics._expectation(gammas[d][None])[0]
            share = np.exp(log_theta)[:, None] * beta[:, words]
            share *= n / share.sum(0)
            sums[:, words] += share
            gammas[d], logs = alpha + share.sum(1), logs + log_theta
        lam, alpha = 1 / 3 + sums, topics._newton(alpha, logs / len(counts), (1024 + sweep) ** -0.51)
    assert np.allclose(alone.topics[0], lam, rtol=1e-3) and np.allclose(alone.alpha[0], alpha, rtol=1e-4)


def test_written_shares_go_with_the_next_sweep(spark, docs):
    vocab, weighted = topics.weighted_counts(docs, min_docs=1, max_share=1.0)
    fit = topics.Fit(topics.bags(weighted), len(vocab), (2,)).go_on(1)
    first = fit.written.inputFiles()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(first)
    exists = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert exists()
    fit.go_on(1)
    assert not exists()
    fit.end()


def test_grid_has_all_sizes_and_iterations(spark, docs, monkeypatch):
    got = called(monkeypatch, "lda_grid", docs, (2, 3), "row_id", iterations=1, min_docs=1, max_share=1.0)
    monkeypatch.setattr(plans, "docs", lambda *_: docs)
    assert plans.lda_grid(spark, "").count() == 2
    assert (tuple(got["ks"]), got["iterations"], got["top"]) == (tuple(range(5, 100)), 800, 15)


@pytest.mark.parametrize(("words", "documents", "fits"), [(335, 1685, 4), (50_000, 10**7, 8), (1, 1, 1)])
def test_no_size_is_left_out(words, documents, fits):
    ks = tuple(range(5, 100))
    groups = topics._side_by_side(ks, words, documents, fits)
    assert sum(groups, ()) == ks and all(len(g) == 1 or sum(g) * words <= topics.MODEL and sum(g) * documents <= topics.SHARES for g in groups)


def test_grid_is_that_of_models_one_by_one(docs):
    options = {"min_docs": 1, "max_share": 1.0}
    for k, p, c in topics.lda_grid(docs, (2, 3, 4), "row_id", iterations=6, top=3, **options).collect():
        model, vocab, weighted = topics.fit_lda(docs, k, iterations=6, **options)
        scores = topics.coherence_cv(docs, topics.top_words(model, vocab, 3), "row_id").collect()
        assert p == pytest.approx(topics.perplexity(model, weighted), rel=1e-3)
        assert c == pytest.approx(sum(r["c_v"] for r in scores) / len(scores), abs=1e-9)

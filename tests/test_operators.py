"""Operators on rows that the tables lack."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gritstone.functions import text as X
from gritstone.operators import clean as C
from gritstone.operators import cluster, corpus, dedup, embed, phrases, reduce, split, topics
from gritstone.operators import keywords as K
from gritstone.operators import merge as M
from gritstone.operators import tokens as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Acme_10-k_20230131.txt", ("Acme", "10-K", 2023)),
        ("Acme_10-K_2022_20230131.txt", ("Acme", "10-K", 2022)),
        ("Acme_10-K.txt", None),
        ("Acme_10-K_2023013.txt", None),
        ("Acme_10-K_year_20230131.txt", None),
    ],
)
def test_filename(spark, name, want):
    rows = C.parse_filename(spark.createDataFrame([(name,)], "filename string")).collect()
    assert [tuple(r)[1:] for r in rows] == ([want] if want else [])


def test_lines(spark):
    text = "﻿##TITLE Item\n ##titlecase stays\n\n a\t\tb​  c \r\nlast"
    rows = C.keep_lines(C.explode_lines(spark.createDataFrame([("f", text)], "filename string, content string"))).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["##titlecase stays", "a b c", "last"]


@pytest.mark.parametrize(("text", "want"), [("12 Table of Contents x", " x"), ("7\n\nTABLE OF CONTENTS", ""), ("1234 table of contents", "1"), ("none", "none"), ("", "")])
def test_contents(spark, text, want):
    assert one(spark, text, C.strip_contents) == want


def test_caps_heading(spark):
    s = "We buy. SUPPLY CHAIN RISK We sell. SUPPLY CHAIN RISK Again"
    assert one(spark, s, C.without_caps_heading) == "We buy.  We sell.  Again"
    assert one(spark, "We buy. MAY RISK ITEM Then", C.without_caps_heading) == "We buy. MAY RISK ITEM Then"


@pytest.mark.parametrize("text", ["Cyber Security Threats may harm the business we run now", "a b", "", "we sell things to people in many places all the time"])
def test_embedded_heading_leaves_bodies(spark, text):
    got = spark.createDataFrame([(text,)], "c string").select(C.without_span(F.col("c"), C.embedded_heading(F.col("c"))).alias("r")).first()["r"]
    assert got == ("may harm the business we run now" if text.startswith("Cyber") else text)


def sequential_split(text, mode, least=6):
    import re

    tok = lambda s: len(re.findall(split.TOKEN, s))
    parts, at = [], 0
    for p in text.split(";"):
        parts.append([p.strip(), at, at + len(p)])
        at += len(p) + 1
    if tok(text) < 40 and len(text) < 200:
        return [(text.rstrip(), 0, len(text))]
    out, i = [], 0
    while i < len(parts):
        cur = parts[i]
        if tok(cur[0]) >= least or len(parts) == 1:
            out.append(cur)
            i += 1
        elif out:
            out[-1] = [f"{out[-1][0]} {cur[0]}".strip(), out[-1][1], cur[2]]
            i += 1
        elif i + 1 < len(parts):
            parts[i + 1] = [f"{cur[0]} {parts[i + 1][0]}".strip(), cur[1], parts[i + 1][2]]
            i += 2 if mode == "reference" else 1
        else:
            out.append(cur)
            i += 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("mode", ["reference", "lossless"])
def test_splitter_against_a_sequential_one(spark, mode):
    r = random.Random(7)
    texts = ["", "short", "a; b", ";" * 250, "x" * 300] + ["; ".join(" ".join(["word"] * r.randint(0, 12)) for _ in range(r.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "sent_id string, sentence_raw string")
    got = {}
    for x in split.split_long(df, forward_merge=mode).orderBy("parent_sent_id", "sub_id").collect():
        got.setdefault(int(x["parent_sent_id"]), []).append((x["sentence_sub"], x["span_start"], x["span_end"]))
    close = lambda s: s if not s or s[-1] in ".!?;" else s + ";"
    for k, t in enumerate(texts):
        assert got.get(k, []) == [(close(a), b, c) for a, b, c in sequential_split(t, mode)], t


def test_split_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([("1", None, "x")], "sent_id string, sentence_raw string, Company string")
    assert split.split_long(df).select("Company", "sentence_sub", "sub_sent_id").first() == Row(Company="x", sentence_sub="", sub_sent_id="1-01")


def sequential_leaders(n, edges):
    near = {i: {} for i in range(n)}
    for a, b, s in edges:
        near[a][b] = near[b][a] = s
    rep = {}
    for i in range(n):
        if i not in rep:
            rep[i] = i
            for j in near[i]:
                rep.setdefault(j, i)
    return rep


@pytest.mark.parametrize("seed", range(4))
def test_leaders_against_the_sequence(spark, seed):
    r = random.Random(seed)
    n = 30
    edges = [(a, b, 0.98) for a in range(n) for b in range(a + 1, n) if r.random() < 0.08]
    rows = spark.range(n).withColumnRenamed("id", "row_index")
    got = dedup.leader_clusters(rows, spark.createDataFrame(edges, "a long, b long, sim double")).collect()
    assert {x["row"]: x["rep"] for x in got} == sequential_leaders(n, edges)


def test_leaders_without_edges(spark):
    got = dedup.leader_clusters(spark.range(3).withColumnRenamed("id", "row_index"), spark.createDataFrame([], "a long, b long, sim double")).collect()
    assert all(x["row"] == x["rep"] and x["sim"] == 1.0 for x in got)


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.97])
def test_similarity_edges_are_complete(spark, threshold):
    v = np.random.default_rng(1).normal(size=(60, 4))
    v[30:] = v[:30] + np.random.default_rng(2).normal(scale=0.15, size=(30, 4))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "row_index long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= threshold}
    assert {(x["a"], x["b"]) for x in dedup.similarity_edges(df, threshold).collect()} == want


def test_normalised(spark):
    assert one(spark, " <b>Risk</b>  is\nHIGH ;,.", dedup.normalised) == "risk is high"
    assert one(spark, None, dedup.normalised) == ""


def test_merging_is_idempotent_and_keeps_noise(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("-1",)], "cluster string")
    m = spark.createDataFrame([("1", "2"), ("2", "2")], "old_cluster string, new_cluster string")
    once = M.apply(rows, m)
    again = M.apply(once.select(F.col("cluster_merged").alias("cluster")), m)
    assert sorted(x["cluster_merged"] for x in once.collect()) == sorted(x["cluster_merged"] for x in again.collect()) == ["-1", "2", "2"]


def test_no_candidates_map_to_themselves(spark):
    sizes = spark.createDataFrame([("a", 10, "small")], "cluster string, n_sentences long, size_flag string")
    none = M.candidates(sizes, spark.createDataFrame([], "a string, b string, sim double"))
    assert [tuple(x) for x in M.mapping(sizes, none, none).collect()] == [("a", "a")]


def test_tokens(spark):
    assert one(spark, "<b>1,000</b> Firms' don't 5%", T.topic_tokens) == ["<NUM>", "firms", "don't", "<NUM>"]
    assert one(spark, ["<NUM>", "The", "x", "Risk"], T.filtered, "array<string>") == ["risk"]
    assert one(spark, "['a', 'b c']", T.coerced) == ["a", "b c"]
    assert one(spark, " a  b ", T.coerced) == ["a", "b"]
    assert one(spark, None, T.coerced) == []
    assert one(spark, ["a_b", "c_d"], lambda c: T.unphrased(c, ["a_b"]), "array<string>") == ["a", "b", "c_d"]
    assert one(spark, ["companies", "losses", "is"], T.lemmatised, "array<string>") == ["company", "loss", "is"]


def test_phrases_merge_greedily(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["b", "c", "a", "b"])], "id long, tokens array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {x["id"]: x["t"] for x in phrases.merge_phrases(docs, pairs, out="t").collect()}
    assert got == {1: ["a_b", "c"], 2: [], 3: ["b_c", "a_b"]}


def test_phrase_counts_at_the_limits(spark):
    docs = spark.createDataFrame([(["a", "b"],)] * 10 + [(["c", "d"],)] * 9 + [(["a", "d"],)] * 3, "tokens array<string>")
    assert {(x["a"], x["b"]) for x in phrases.scored_pairs(docs, min_count=10, threshold=0.0).collect()} == {("a", "b")}
    assert phrases.scored_pairs(docs, min_count=10, threshold=1.0).count() == 0


def test_safe_threshold():
    assert (phrases.safe_threshold(-2), phrases.safe_threshold(5), phrases.safe_threshold(5, "default")) == (-1.0, 0.3, 5)


def test_hdbscan_finds_planted_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-3, 9, (8, 2))])
    labels, prob = cluster.hdbscan(x, 20)
    assert len(set(labels[:180]) - {-1}) == 3 and all(len(set(labels[k : k + 60]) - {-1}) == 1 for k in (0, 60, 120))
    assert labels.min() >= -1 and 0 <= prob.min() and prob.max() <= 1


def test_linkage(spark):
    sims = [("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.2)]
    rows = sims + [(b, a, s) for a, b, s in sims] + [(x, x, 1.0) for x in "abc"]
    got = cluster.average_linkage(spark.createDataFrame(rows, "a string, b string, sim double")).orderBy("step").collect()
    assert [(x["left"], x["right"], round(x["distance"], 6), x["size"]) for x in got] == [(0, 1, 0.1, 2), (2, 3, 0.85, 3)]


def test_layouts(spark):
    v = np.random.default_rng(0).normal(size=(40, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "row_id long, embedding array<double>")
    assert all(len(x["reduced"]) == 2 and np.isfinite(x["reduced"]).all() for x in reduce.umap(df).collect())
    assert all(len(x["reduced"]) == 3 for x in reduce.pca(df, 3).collect())


def test_models(spark):
    df = spark.createDataFrame([(1, "strong growth"), (2, "loss and litigation"), (3, None)], "id long, t string")
    assert {x["id"]: x["sentiment_label"] for x in embed.sentiment(df, "t").collect()} == {1: "positive", 2: "negative", 3: "neutral"}
    norms = [np.linalg.norm(x["embedding"]) for x in embed.embed(df, "t").collect()]
    assert norms[:2] == pytest.approx([1, 1], abs=1e-5)


def test_measures_take_every_row(spark):
    """More rows than were once sampled, a few of them copies and one without a vector."""
    v = np.random.default_rng(3).normal(size=(4500, 6)).astype(np.float32)
    v[4400:] = v[:100]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9999, None)], "row_id long, embedding array<float>")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-12
    s = u @ u.T
    pairs = s[np.triu_indices(len(s), 1)]
    got = embed.pairwise_stats(df).first()
    assert got["pairs"] == len(pairs)
    assert tuple(got)[1:] == pytest.approx((pairs.mean(), np.quantile(pairs, 0.9), np.quantile(pairs, 0.99), (pairs > 0.9).mean()), abs=1e-9)
    np.fill_diagonal(s, -2)
    top = -np.sort(-s, axis=1)[:, :10]
    knn = {x["k"]: (x["mean"], x["p90"]) for x in embed.knn_stats(df).collect()}
    assert all(knn[k] == pytest.approx((top[:, :k].mean(), np.quantile(top[:, :k], 0.9)), abs=1e-9) for k in (1, 5, 10))
    t = v[:, ::-1] * np.arange(1, 7)
    t /= np.linalg.norm(t, axis=1, keepdims=True) + 1e-12
    want = (t * t[s.argmax(axis=1)]).sum(axis=1)
    other = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(t)], "row_id long, embedding array<double>")
    assert tuple(embed.transfer(df, other).first()) == pytest.approx((want.mean(), np.quantile(want, 0.9), np.quantile(want, 0.99)), abs=1e-6)


def test_silhouette_takes_every_row(spark, monkeypatch):
    from pyspark.ml.evaluation import ClusteringEvaluator

    seen, evaluate = [], ClusteringEvaluator.evaluate
    monkeypatch.setattr(ClusteringEvaluator, "evaluate", lambda self, rows: seen.append(rows.count()) or evaluate(self, rows))
    v = np.random.default_rng(4).normal(size=(4100, 6))
    embed.quick_silhouette(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "row_id long, embedding array<double>"))
    assert seen == [4100]


def test_embedder_halves_batches(spark):
    def picky():
        def run(texts):
            if len(texts) > 10:
                raise MemoryError
            return np.zeros((len(texts), 2))

        return run

    df = spark.range(50).select(F.col("id").cast("string").alias("t"))
    assert embed.embed(df, "t", picky).count() == 50


def test_lda_shares_sum_to_one(spark):
    docs = spark.createDataFrame([(k, ["a", "b"] if k % 2 else ["c", "d"]) for k in range(60)], "id long, tokens array<string>")
    model, vocab, weighted = topics.fit_lda(docs, 2, iterations=5, min_docs=1, max_share=0.9)
    assert all(abs(sum(x["theta"]) - 1) < 1e-6 for x in topics.document_topics(model, weighted, "id").collect())
    assert topics.top_words(model, vocab, 2).count() == 4 and topics.perplexity(model, weighted) > 0


def test_dictionary_queries_keep_more_than_2000_tokens(spark, monkeypatch):
    from gritstone.plans import topics as plans

    rows = [(k, [f"t{j}" for j in range(2100) if (k - j) % 100 < 20]) for k in range(100)]
    docs = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    sizes, fit = [], topics.fit_lda

    def fitted(*args, **options):
        out = fit(*args, **options)
        sizes.append(len(out[1]))
        return out

    monkeypatch.setattr(plans, "docs", lambda *_: docs)
    monkeypatch.setattr(topics, "fit_lda", fitted)
    assert plans.dictionary_filter(spark, "").count() == 2100
    assert {x["row_id"]: x["tokens"].split() for x in plans.dictionary_docs(spark, "").collect()} == dict(rows)
    plans.lda_topics(spark, ""), plans.lda_doc_topics(spark, "")
    assert sizes == [2100, 2100]


def test_labels_need_only_one_input(spark):
    w = spark.createDataFrame([(1, k, t) for k, t in enumerate(["Risk", " ", "united_states", "market"])], "topic_id long, rank long, term string")
    p = spark.createDataFrame([(2, 1, "x_y")], "topic_id long, rank long, term string")
    s = spark.createDataFrame([(3, 1, "text")], "topic_id long, rank long, text string")
    assert {x["topic_id"]: tuple(x)[1:] for x in topics.label_table(w, p, s).collect()} == {1: ("risk, market", None, None), 2: (None, "x_y", None), 3: (None, None, "text")}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "row_id long, tokens array<string>")
    assert corpus.corpus_stats(docs).first()["documents"] == 0
    assert T.nonempty_view(docs).count() == 0
    assert topics.dictionary(docs).count() == 0
    assert K.vocabulary(K.document_terms(spark.createDataFrame([], "doc string, text string"), "doc", "text")).count() == 0


@pytest.mark.parametrize(("s", "want"), [("Hello World", True), ("Don'T Do", True), ("Don't", False), ("A1b", False), ("HELLO", False), ("É Où", True), ("123", False)])
def test_is_title(spark, s, want):
    assert one(spark, s, X.is_title) == want == s.istitle()


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], X.norm, "array<double>") == 5.0
    assert one(spark, [0.0, 2.0, 2.0], X.argmax, "array<double>") == 1
    assert sum(one(spark, [1.0, 2.0, 3.0], X.softmax, "array<double>")) == pytest.approx(1)

"""Operators against independent small implementations, where SQL does not reach."""

import random
import zipfile
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import sequential_leaders

from gritstone.operators import clean, cluster, dedup, embed, phrases, topics
from gritstone.operators import components as CC
from gritstone.operators import tokens as T
from gritstone.plans import adapters
from gritstone.plans.registry import QUERIES
from gritstone.sources import io


def edge_table(spark, edges):
    return spark.createDataFrame([(a, b, 0.98) for a, b in edges], "a long, b long, sim double")


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_leaders_of_chains_hubs_and_random_graphs(spark, few):
    """An ordered chain settles two rows a round: it must not meet a limit of rounds."""
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(899)] + [(1000, k) for k in range(1001, 1100)] + [(a, b) for a in range(2000, 2040) for b in range(a + 1, 2040) if r.random() < 0.1]
    rows = spark.range(2100).withColumnRenamed("id", "row_index")
    got = dedup.leader_clusters(rows, edge_table(spark, edges), few=few).collect()
    assert {x["row"]: x["rep"] for x in got} == sequential_leaders(2100, [(a, b, 0.98) for a, b in edges])


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 200)]
    got = {r["node"]: r["component"] for r in CC.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 200), 100)}


@pytest.mark.parametrize(("threshold", "pivots", "tile"), [(0.97, 9, 8), (0.9, 5, 16), (0.3, 4, 7), (1 - 1e-12, 3, 16), (0.97, None, 1024)])
def test_similarity_edges_with_pivots_and_tiles(spark, threshold, pivots, tile):
    g = np.random.default_rng(3)
    v = g.normal(size=(150, 6))
    v[50:100] = v[0] + g.normal(scale=0.05, size=(50, 6))  # a third of the rows are near copies
    v[100:110] = v[1]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "row_index long, embedding array<double>")
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if (u[a] * u[b]).sum() >= threshold}
    got = [(x["a"], x["b"]) for x in dedup.similarity_edges(df, threshold, pivots=pivots, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("literal", "want"), [("['a', 'b']", ["a", "b"]), ("[\"it's\", 'b']", ["it's", "b"]), (r"['it\'s', 'x y']", ["it's", "x y"]), ('["a", "b"]', ["a", "b"]), ("[]", []), ("a  b", ["a", "b"]), ("[1, 2]", ["1", "2"]), (None, []), ("['a', ' ']", ["a"])])
def test_list_literals(spark, literal, want):
    assert spark.createDataFrame([(literal,)], "c string").select(T.coerced(F.col("c")).alias("t")).first()["t"] == want


def test_large_and_small_phrase_models_merge_alike(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, [r.choice("abcdef") for _ in range(r.randint(0, 20))]) for k in range(200)] + [(500, None)]
    docs = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    bi, tri = phrases.fit_model(docs, bigram=(3, -0.2), trigram=(2, -0.2), id_col="row_id")
    phrases.save_model(bi, tri, str(tmp_path / "model"))
    bi, tri = phrases.load_model(spark, str(tmp_path / "model"))
    assert bi.count() and tri.count()
    whole = {x["row_id"]: x["tokens_tri"] for x in phrases.apply_model(docs, bi, tri).collect()}
    for id_col in ("row_id", None):
        once = phrases.merge_phrases(docs, bi, id_col=id_col, small=0)
        twice = phrases.merge_phrases(once, tri, "tokens_bi", "tokens_tri", id_col=id_col, small=0)
        assert {x["row_id"]: x["tokens_tri"] for x in twice.collect()} == whole
    accepted = {(x["a"], x["b"]) for x in bi.collect()}
    once = {x["row_id"]: x["tokens_bi"] for x in phrases.merge_phrases(docs, bi).collect()}
    for k, tokens in rows[:-1]:
        out, last = [], None
        for t in tokens:
            if last is not None and (last, t) in accepted:
                out[-1], last = f"{last}_{t}", None
            else:
                out.append(t)
                last = t
        assert once[k] == out


def test_average_linkage_against_mean_distances(spark):
    g = np.random.default_rng(7)
    d = g.random((9, 9))
    d = (d + d.T) / 2
    names = [f"c{k}" for k in range(9)]
    sims = spark.createDataFrame([(a, b, 1.0 if i == j else float(1 - d[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, sim double")
    labels = spark.createDataFrame([(n, k + 10, "small") for k, n in enumerate(names)], "cluster string, n_sentences long, size_flag string")
    got = sorted(cluster.average_linkage(sims, labels).collect(), key=lambda r: r["step"])
    groups = {k: [k] for k in range(9)}
    for step, row in enumerate(got):
        mean = lambda x, y: np.mean([d[i, j] for i in groups[x] for j in groups[y]])
        best = min((mean(x, y), x, y) for x in groups for y in groups if x < y)
        assert {row["left"], row["right"]} == {best[1], best[2]} and row["distance"] == pytest.approx(best[0])
        groups[9 + step] = groups.pop(best[1]) + groups.pop(best[2])
        assert row["size"] == len(groups[9 + step])
        assert row["left_label"] == (f"c{row['left']} (n={row['left'] + 10},small)" if row["left"] < 9 else None)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = adapters.clustered(spark, SMALL).orderBy("row_id").collect()
    return [r["row_id"] for r in rows], np.array([r["embedding"] for r in rows])


def test_principal_components(spark, vectors):
    ids, v = vectors
    got = {r["row_id"]: r["reduced"] for r in QUERIES["pca_reduce"](spark, SMALL).collect()}
    axes = np.linalg.svd(v - v.mean(0), full_matrices=False)[2][:32]
    want = v @ axes.T
    have = np.array([got[i] for i in ids])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-6)


def test_reductions_of_several_sizes(spark, vectors):
    ids, v = vectors
    rows = QUERIES["reduce_set"](spark, SMALL).collect()
    axes = np.linalg.svd(v - v.mean(0), full_matrices=False)[2]
    assert {r["d"] for r in rows} == {d for d in (8, 32, 64) if d <= v.shape[1]}
    got = {(r["d"], r["row_id"]): r["reduced"] for r in rows}
    assert np.allclose(np.abs([got[8, i] for i in ids]), np.abs(v @ axes[:8].T), atol=1e-6)


def test_first_singular_share(spark, vectors):
    values = np.linalg.svd(vectors[1] - vectors[1].mean(0), compute_uv=False)
    assert QUERIES["sv1_fraction"](spark, SMALL).first()["sv1_frac"] == pytest.approx(values[0] / values.sum(), abs=1e-6)


def test_silhouette(spark, vectors):
    v = vectors[1]
    axes = np.random.default_rng(42).normal(size=(8, v.shape[1]))
    p = v @ axes.T
    label = np.abs(np.floor((p - p.mean(0)) / (p.std(0) + 1e-6)).sum(axis=1)) % 10
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = 1 - u @ u.T
    scores = []
    for k in range(len(v)):
        own = label == label[k]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = far[k][own].sum() / (own.sum() - 1)
        b = min(far[k][label == x].mean() for x in set(label) - {label[k]})
        scores.append((b - a) / max(a, b))
    assert QUERIES["quick_silhouette"](spark, SMALL).first()["silhouette"] == pytest.approx(np.mean(scores), abs=1e-6)


def test_embeddings_of_texts(spark):
    got = {r["row_id"]: r["embedding"] for r in QUERIES["embed_texts"](spark, SMALL).limit(300).collect()}
    texts = {r["row_id"]: r["sentence"] for r in adapters.sentences(spark, SMALL).where(F.col("row_id").isin(list(got))).collect()}
    for k, v in got.items():
        t, want = f" {texts[k].lower()} ".encode(), np.zeros(64)
        for j in range(len(t) - 2):
            h = zlib.crc32(t[j : j + 3])
            want[h % 64] += 1.0 if h >> 31 else -1.0
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-12), atol=1e-6)


def test_text_sample(spark):
    got = [r["sentence"] for r in QUERIES["text_sample"](spark, SMALL).collect()]
    every = {r["sentence"].strip(" ") for r in adapters.sentences(spark, SMALL).collect()} - {""}
    assert len(got) == len(set(got)) == 300 and set(got) <= every
    assert got == [r["sentence"] for r in QUERIES["text_sample"](spark, SMALL).collect()]


def test_density_grid_and_layout(spark, vectors):
    """Every solution labels every row, keeps its least size, and the layout keeps neighbours together."""
    ids, v = vectors
    rows = QUERIES["hdbscan_grid"](spark, SMALL).collect()
    for solution, least in ((1, 5), (2, 10), (3, 15)):
        mine = [r for r in rows if r["solution"] == solution]
        assert sorted(r["row"] for r in mine) == sorted(ids)
        counts = {}
        for r in mine:
            counts[r["label"]] = counts.get(r["label"], 0) + 1
            assert 0 <= r["prob"] <= 1 and (r["label"] >= 0 or r["prob"] == 0)
        assert all(n >= least for label, n in counts.items() if label >= 0)
    y = {r["row_id"]: r["reduced"] for r in QUERIES["umap_reduce"](spark, SMALL).collect()}
    flat = np.array([y[i] for i in ids])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.argsort(-(u @ u.T), axis=1)[:, 1:6]
    apart = np.linalg.norm(flat[:, None] - flat[None], axis=2)
    assert np.mean([apart[k, near[k]].mean() for k in range(len(ids))]) < 0.7 * apart.mean()


def test_density_clusters_against_single_linkage():
    """With one sample and no noise, density clusters of well-parted groups are those of cutting the spanning tree."""
    g = np.random.default_rng(11)
    points = np.concatenate([g.normal(c, 0.2, size=(30, 3)) for c in (0, 5, 10, 20)])
    labels, _ = cluster.hdbscan(points, 10)
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    for a, b in zip(*np.nonzero(far < 2.0), strict=True):
        up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k in range(len(points)):
        groups.setdefault(root(k), set()).add(labels[k])
    assert len(groups) == 4
    main = [max(x, key=lambda label: sum(labels[k] == label for k in range(len(points)) if root(k) == r)) for r, x in groups.items()]
    assert len(set(main)) == 4 and -1 not in main


def test_topics_of_planted_words(spark):
    """Two vocabularies that never meet come out as topics of their own."""
    r = random.Random(1)
    docs = spark.createDataFrame([(k, [r.choice(["sun", "sea", "sand", "salt"] if k % 2 else ["cat", "dog", "cow", "hen"]) for _ in range(30)]) for k in range(200)], "row_id long, tokens array<string>")
    model, vocab, weighted = topics.fit_lda(docs, 2, iterations=20, min_docs=1, max_share=1.0)
    words = {}
    for x in topics.top_words(model, vocab, 4).collect():
        words.setdefault(x["topic_id"], set()).add(x["word"])
    assert sorted(map(sorted, words.values())) == [["cat", "cow", "dog", "hen"], ["salt", "sand", "sea", "sun"]]
    thetas = {x["row_id"]: x["dominant_topic"] for x in topics.document_topics(model, weighted, "row_id").collect()}
    assert len({(k % 2, t) for k, t in thetas.items()}) == 2
    grid = topics.lda_grid(docs, (2, 3), "row_id", iterations=5, min_docs=1, max_share=1.0).collect()
    assert [g["K"] for g in grid] == [2, 3] and all(g["perplexity"] > 0 and -1 <= g["coherence_c_v"] <= 1 for g in grid)


@pytest.mark.parametrize("name", ["lda_topics", "lda_doc_topics", "lda_grid", "lda_final"])
def test_topic_models_are_distributions(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]
    assert rows
    for r in rows:
        if "theta" in r:
            # A document without any word of the vocabulary has no shares.
            assert (sum(r["theta"]) == pytest.approx(1) or not any(r["theta"])) and r["theta"][r["dominant_topic"]] == max(r["theta"]) == r["dominant_prob"]
        if "prob" in r:
            assert 0 < r["prob"] <= 1
    if name in ("lda_topics", "lda_final"):
        for t in {r["topic_id"] for r in rows}:
            probs = [r["prob"] for r in sorted(rows, key=lambda r: r["rank"]) if r["topic_id"] == t]
            assert probs == sorted(probs, reverse=True) and sum(probs) <= 1 + 1e-9


def test_merging_needs_keys(spark):
    a, b = spark.createDataFrame([(1, 2)], "x long, y long"), spark.createDataFrame([(1, 2)], "z long, y2 long")
    with pytest.raises(ValueError):
        topics.smart_merge(a, b)
    d = spark.createDataFrame([(1, "s"), (9, "s")], "doc_id long, sent_id string")
    o = spark.createDataFrame([(1, "s", "late", 2), (1, "s", "early", 1), (2, "s", "x", 1)], "doc_id long, sent_id string, text string, n long")
    assert sorted((r["doc_id"], r["text"] or "") for r in topics.smart_merge(d, o, order="n").collect()) == [(1, "early"), (9, "")]


def test_first_known_values(spark):
    info = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "b2", "y"), ("b", 1, None, None)], "Company string, n long, p string, q string")
    got = clean.enrich(spark.createDataFrame([("a",), ("b",), ("c",)], "Company string"), info, order="n").collect()
    assert sorted((r["Company"], r["p"] or "", r["q"] or "") for r in got) == [("a", "b2", "x"), ("b", "", ""), ("c", "", "")]


def test_cleaned_files(spark):
    text = "Risks Related to Our Own Business\n\nWe may not be able to sell anything at all this year.\n\nAnother plain paragraph follows here."
    got = clean.cleaned_files(clean.clean_titles(spark.createDataFrame([("f", text), ("g", None)], "filename string, content string"), ["filename"])).collect()
    f = next(r for r in got if r["filename"] == "f")
    assert f["text"] == "We may not be able to sell anything at all this year.\n\nAnother plain paragraph follows here."
    assert f["removed_titles"] == "Risks Related to Our Own Business"


def test_sampled_pairs_differ(spark, vectors):
    got = embed.sample_pairs(adapters.clustered(spark, SMALL), 2000).collect()
    ids, v = vectors
    u = dict(zip(ids, v / np.linalg.norm(v, axis=1, keepdims=True), strict=True))
    assert len(got) == 2000 and all(r["a"] != r["b"] and abs(u[r["a"]] @ u[r["b"]] - r["sim"]) < 1e-9 for r in got)


def sheet(path, rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="{t}">{body}</c>' for c, t, body in row) + "</row>" for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Company</t></si><si><r><t>Sec</t></r><r><t>tor</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    sheet(tmp_path / "s.xlsx", [[("A", "s", "<v>0</v>"), ("C", "s", "<v>1</v>")], [("A", "inlineStr", "<is><t>ACME</t></is>"), ("B", "n", "<v>3.5</v>")], [("C", "str", "<v>z</v>")]])
    got = io.read_table(spark, str(tmp_path / "s.xlsx"))
    assert got.columns == ["Company", "column2", "Sector"]
    assert [tuple(r) for r in got.collect()] == [("ACME", "3.5", None), (None, None, "z")]


@pytest.mark.parametrize("quote_all", [False, True])
def test_csv_with_a_mark(spark, tmp_path, quote_all):
    df = spark.createDataFrame([("a,b", 'say "x"', 1), ("c", None, 2)], "k string, `l m` string, n long")
    io.write_csv(df.coalesce(1), str(tmp_path / "o"), quote_all, bom=True)
    part = next((tmp_path / "o").glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf" + (b'"k"' if quote_all else b"k"))
    assert [tuple(r) for r in io.read_delimited(spark, str(tmp_path / "o")).collect()] == [("a,b", 'say "x"', "1"), ("c", None, "2")]


def test_strict_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff bad")
    assert io.read_texts(spark, str(tmp_path)).first()["content"] == "ok  bad"
    with pytest.raises(Exception, match="UTF"):
        io.read_texts(spark, str(tmp_path), strict=True).collect()

"""Queries over clusters: sizes, centroids, similarity, merging, keywords, naming, embedding quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import embed as E
from ..operators import keywords as K
from ..operators import merge as M
from ..operators import reduce as R
from .adapters import CLUSTER_SENTENCES, CLUSTERED, SENTENCES, cluster_sentences, clustered, sentences, table
from .filings import sql_list

QUERIES, ORACLE_SQL = {}, {}
#: Size limits that put the small test tables into all three classes.
SMALL, LARGE = 45, 52


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


SIZES = f"SELECT cluster, count(*) AS n_sentences, CASE WHEN count(*) < {SMALL} THEN 'small' WHEN count(*) > {LARGE} THEN 'large' ELSE 'medium' END AS size_flag FROM ({CLUSTERED}) WHERE cluster <> '-1' GROUP BY 1"


def kept(spark, sf_dir):
    return C.without_noise(clustered(spark, sf_dir))


def sizes(spark, sf_dir):
    return C.sizes(kept(spark, sf_dir), small=SMALL, large=LARGE)


@query(SIZES)
def cluster_sizes_flag(spark, sf_dir):
    return sizes(spark, sf_dir)


@query(f"SELECT count(DISTINCT cluster) FILTER (cluster <> '-1') AS n_clusters, count(*) FILTER (cluster <> '-1') AS assigned, count(*) FILTER (cluster = '-1') AS noise, round_even(count(*) FILTER (cluster = '-1') / count(*), 4) AS noise_ratio FROM ({CLUSTERED})")
def cluster_summary_noise(spark, sf_dir):
    return C.summary(clustered(spark, sf_dir))


COMPONENTS = f"SELECT cluster, k, avg(v) AS x FROM (SELECT cluster, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding) AS v FROM ({CLUSTERED}) WHERE cluster <> '-1') GROUP BY ALL"
CENTROIDS = f"SELECT cluster, list(x ORDER BY k) AS c FROM ({COMPONENTS}) GROUP BY 1"


@query(f"SELECT cluster, k, round(x, 6) AS x FROM ({COMPONENTS})")
def cluster_centroids(spark, sf_dir):
    c = C.centroids(kept(spark, sf_dir)).select("cluster", F.posexplode("centroid").alias("k", "x"))
    return c.select("cluster", (F.col("k") + 1).cast("bigint").alias("k"), *r6("x"))


CENTRES = f"SELECT cluster, avg(x) AS x, avg(y) AS y FROM ({CLUSTERED}) WHERE cluster <> '-1' GROUP BY 1"


@query(f"SELECT c.cluster, round(x, 6) AS x, round(y, 6) AS y, n_sentences, size_flag FROM ({CENTRES}) c JOIN ({SIZES}) s ON c.cluster = s.cluster")
def centroid_bubbles(spark, sf_dir):
    return C.means_2d(kept(spark, sf_dir)).join(sizes(spark, sf_dir), "cluster").select("cluster", *r6("x", "y"), "n_sentences", "size_flag")


NORMED = "list_transform({c}, lambda v: v / (sqrt(list_sum(list_transform({c}, lambda w: w * w))) + 1e-12))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
UNITS = f"SELECT cluster, {NORMED.format(c='c')} AS u FROM ({CENTROIDS})"
SIM = f"SELECT p.cluster AS a, q.cluster AS b, CASE WHEN p.cluster = q.cluster THEN 1.0 ELSE {DOT.format(a='p.u', b='q.u')} END AS sim FROM ({UNITS}) p, ({UNITS}) q"


def similarity(spark, sf_dir):
    return C.centroid_similarity(C.centroids(kept(spark, sf_dir)))


@query(f"SELECT a, b, round(sim, 6) AS sim FROM ({SIM})")
def centroid_similarity(spark, sf_dir):
    return similarity(spark, sf_dir).select("a", "b", *r6("sim"))


LEAST = -1.0
TOPK = f"""SELECT source, target, round_even(sim, 4) AS similarity, size_flag AS target_size_flag, n_sentences AS target_n_sentences FROM (
SELECT a AS source, b AS target, sim, t.size_flag, t.n_sentences, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM ({SIM}) JOIN ({SIZES}) s ON s.cluster = a AND s.size_flag = 'small' JOIN ({SIZES}) t ON t.cluster = b AND t.size_flag <> 'small' WHERE a <> b)
WHERE r <= 3 AND sim >= {LEAST}"""


def topk(spark, sf_dir):
    # Centroids of random vectors are hardly alike, so the floor is low here; 0.60 is the default.
    return M.candidates(sizes(spark, sf_dir), similarity(spark, sf_dir), 3, LEAST)


@query(TOPK)
def merge_candidates_topk(spark, sf_dir):
    return topk(spark, sf_dir)


DISTANT = f"SELECT k.*, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS umap_dist FROM ({TOPK}) k JOIN ({CENTRES}) p ON p.cluster = source JOIN ({CENTRES}) q ON q.cluster = target"
FILTERED = f"SELECT * FROM ({DISTANT}) WHERE umap_dist <= (SELECT quantile_cont(umap_dist, 0.40) FROM ({DISTANT}))"


def filtered(spark, sf_dir):
    return M.near(M.with_distance(topk(spark, sf_dir), C.means_2d(kept(spark, sf_dir))), 0.40)


@query(f"SELECT source, target, similarity, target_size_flag, target_n_sentences, round(umap_dist, 6) AS umap_dist FROM ({FILTERED})")
def merge_candidates_filtered(spark, sf_dir):
    return filtered(spark, sf_dir).select("source", "target", "similarity", "target_size_flag", "target_n_sentences", *r6("umap_dist"))


MAPPING = f"""WITH f AS ({FILTERED}), pool AS (SELECT source, target, similarity FROM f UNION ALL SELECT source, target, similarity FROM ({TOPK}) WHERE (SELECT count(*) FROM f) = 0),
best AS (SELECT source, target FROM pool QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) = 1)
SELECT cluster AS old_cluster, coalesce(target, cluster) AS new_cluster FROM ({SIZES}) LEFT JOIN best ON source = cluster"""


def mapping(spark, sf_dir):
    return M.mapping(sizes(spark, sf_dir), filtered(spark, sf_dir), topk(spark, sf_dir))


@query(MAPPING)
def merge_mapping(spark, sf_dir):
    return mapping(spark, sf_dir)


@query(f"SELECT row_id, cluster, coalesce(new_cluster, cluster) AS cluster_merged FROM ({CLUSTERED}) LEFT JOIN ({MAPPING}) ON old_cluster = cluster")
def apply_merge(spark, sf_dir):
    return M.apply(clustered(spark, sf_dir).select("row_id", "cluster"), mapping(spark, sf_dir))


@query(f"SELECT new_cluster, CAST(sum(n_sentences) AS BIGINT) AS n_sentences FROM ({SIZES}) JOIN ({MAPPING}) ON old_cluster = cluster GROUP BY 1")
def merged_sizes(spark, sf_dir):
    return M.merged_sizes(sizes(spark, sf_dir), mapping(spark, sf_dir))


@query(f"SELECT new_cluster AS cluster, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM ({CENTRES}) JOIN ({MAPPING}) ON old_cluster = cluster GROUP BY 1")
def merged_centroids(spark, sf_dir):
    return M.merged_centres(C.means_2d(kept(spark, sf_dir)), mapping(spark, sf_dir)).select("cluster", *r6("x", "y"))


UROWS = f"SELECT row_id, cluster, {NORMED.format(c='embedding')} AS u FROM ({CLUSTERED}) WHERE cluster <> '-1'"
REP_CENT = f"SELECT cluster, {NORMED.format(c='c')} AS m FROM (SELECT cluster, list(x ORDER BY k) AS c FROM (SELECT cluster, k, avg(v) AS x FROM (SELECT cluster, unnest(range(1, len(u) + 1)) AS k, unnest(u) AS v FROM ({UROWS})) GROUP BY ALL) GROUP BY 1)"


@query(f"SELECT cluster, rank, row_id, round(score, 6) AS score_sim FROM (SELECT r.cluster, row_id, {DOT.format(a='u', b='m')} AS score, row_number() OVER (PARTITION BY r.cluster ORDER BY {DOT.format(a='u', b='m')} DESC, row_id) AS rank FROM ({UROWS}) r JOIN ({REP_CENT}) c ON c.cluster = r.cluster) WHERE rank <= 5")
def representative_sentences_emb(spark, sf_dir):
    return C.representatives(kept(spark, sf_dir)).select("cluster", "rank", "row_id", *r6("score_sim"))


def _tf(source: str, doc: str, text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}')"
    return f"SELECT doc, term, count(*) AS tf FROM (SELECT {doc} AS doc, unnest(list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || ' ' || z[2]))) AS term FROM (SELECT {doc}, {w} AS w FROM ({source}))) GROUP BY ALL"


CDOCS = f"SELECT cluster, string_agg(sentence, chr(10) ORDER BY row_id) AS text FROM ({CLUSTER_SENTENCES}) GROUP BY 1"
TF = _tf(CDOCS, "cluster", "text")
VOCAB = "SELECT term, ln((1 + (SELECT count(DISTINCT doc) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000"
WEIGHTS = "SELECT doc, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)) AS w FROM {tf} JOIN vocab USING (term)"
WITH = f"WITH tf AS MATERIALIZED ({TF}), vocab AS MATERIALIZED ({VOCAB}), cw AS MATERIALIZED ({WEIGHTS.format(tf='tf')})"


def _cluster_weights(spark, sf_dir):
    return K.cluster_weights(cluster_sentences(spark, sf_dir))


@query(f"{WITH} SELECT doc, rank, term, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(w, 9) DESC, term) AS rank FROM cw) WHERE rank <= 20")
def tfidf_keywords(spark, sf_dir):
    w = _cluster_weights(spark, sf_dir)[0].withColumn("w", F.round("w", 9))
    return K.keywords(w).select("doc", "rank", "term", *r6("w"))


@query(f"{WITH} SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE s END, 6) AS sim FROM (SELECT p.doc AS a, q.doc AS b, sum(p.w * q.w) AS s FROM cw p JOIN cw q ON p.term = q.term GROUP BY p.doc, q.doc)")
def tfidf_cluster_similarity(spark, sf_dir):
    return K.similarity(_cluster_weights(spark, sf_dir)[0]).select("a", "b", *r6("sim"))


SENT_TF = _tf(CLUSTER_SENTENCES, "row_id", "sentence")
REPS = f"""{WITH}, sw AS MATERIALIZED ({WEIGHTS.format(tf=f'({SENT_TF})')}), reps AS (SELECT cluster, row_id, score, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, row_id) AS rank FROM (
SELECT s.cluster, s.row_id, sum(sw.w * cw.w) AS score FROM sw JOIN ({CLUSTER_SENTENCES}) s ON s.row_id = sw.doc JOIN cw ON cw.doc = s.cluster AND cw.term = sw.term GROUP BY ALL))"""


@query(f"{REPS} SELECT cluster, rank, row_id, round(score, 6) AS score_tfidf FROM reps WHERE rank <= 5")
def representative_sentences_tfidf(spark, sf_dir):
    w, vocab = _cluster_weights(spark, sf_dir)
    return K.representatives(cluster_sentences(spark, sf_dir), w, vocab).select("cluster", "rank", "row_id", *r6("score_tfidf"))


@query(f"""{REPS} SELECT n.cluster, n_sentences, top_keywords, r.sentence AS representative FROM (SELECT cluster, count(*) AS n_sentences FROM ({CLUSTER_SENTENCES}) GROUP BY 1) n
LEFT JOIN (SELECT doc, string_agg(term, ', ' ORDER BY rank) AS top_keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(w, 9) DESC, term) AS rank FROM cw) WHERE rank <= 20 GROUP BY 1) k ON k.doc = n.cluster
LEFT JOIN (SELECT p.cluster, s.sentence FROM reps p JOIN ({CLUSTER_SENTENCES}) s ON s.row_id = p.row_id WHERE rank = 1) r ON r.cluster = n.cluster""")
def naming_sheet(spark, sf_dir):
    s = cluster_sentences(spark, sf_dir)
    w, vocab = _cluster_weights(spark, sf_dir)
    return K.naming_sheet(C.sizes(s), K.keywords(w.withColumn("w", F.round("w", 9))), K.representatives(s, w, vocab), s)


@query(f"SELECT row_id, x, y, CASE WHEN cluster = '-1' THEN 'NA' ELSE cluster END AS label FROM ({CLUSTERED})")
def scatter_by_label(spark, sf_dir):
    return clustered(spark, sf_dir).select("row_id", "x", "y", F.when(F.col("cluster") == "-1", "NA").otherwise(F.col("cluster")).alias("label"))


ALL_UNITS = f"SELECT row_id, {NORMED.format(c='embedding')} AS u, sqrt(list_sum(list_transform(embedding, lambda w: w * w))) AS norm FROM ({CLUSTERED})"
ALL_PAIRS = f"SELECT p.row_id AS a, q.row_id AS b, {DOT.format(a='p.u', b='q.u')} AS sim FROM ({ALL_UNITS}) p JOIN ({ALL_UNITS}) q ON p.row_id < q.row_id"


@query(f"SELECT count(*) AS pairs, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.9), 6) AS p90, round(quantile_cont(sim, 0.99), 6) AS p99, round(avg(CASE WHEN sim > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS frac_above_09 FROM ({ALL_PAIRS})")
def pairwise_cosine_stats(spark, sf_dir):
    return E.pairwise_stats(clustered(spark, sf_dir)).select("pairs", *r6("mean", "p90", "p99", "frac_above_09"))


@query(f"SELECT count(*) AS n, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std FROM ({ALL_UNITS})")
def embedding_norms(spark, sf_dir):
    return E.norms(clustered(spark, sf_dir)).select("n", *r6("norm_mean", "norm_std"))


NEAR = f"SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM (SELECT a, b, sim FROM ({ALL_PAIRS}) UNION ALL SELECT b, a, sim FROM ({ALL_PAIRS}))"


KNN = " UNION ALL ".join(f"SELECT {k} AS k, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.9), 6) AS p90 FROM near WHERE r <= {k}" for k in (1, 5, 10))


@query(f"WITH near AS MATERIALIZED ({NEAR}) {KNN}")
def knn_similarity(spark, sf_dir):
    return E.knn_stats(clustered(spark, sf_dir), (1, 5, 10)).select("k", *r6("mean", "p90"))


#: A second embedding of the same rows: the components in reverse, halved where odd.
OTHER = f"SELECT row_id, {NORMED.format(c='half')} AS u FROM (SELECT row_id, list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 0 THEN x / 2 ELSE x END) AS half FROM ({CLUSTERED}))"


@query(f"SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 0.99), 6) AS p99 FROM (SELECT {DOT.format(a='p.u', b='q.u')} AS s FROM ({NEAR}) n JOIN ({OTHER}) p ON p.row_id = a JOIN ({OTHER}) q ON q.row_id = b WHERE r = 1)")
def cross_model_nn(spark, sf_dir):
    d = clustered(spark, sf_dir)
    other = d.select("row_id", F.transform("embedding", lambda x, i: F.when((i + 1) % 2 == 0, x / 2).otherwise(x)).alias("embedding"))
    return E.transfer(d, other).select(*r6("mean", "p90", "p99"))


@query()
def average_linkage(spark, sf_dir):
    return C.average_linkage(similarity(spark, sf_dir), sizes(spark, sf_dir))


@query(f"""SELECT cluster FROM ({SIZES}) WHERE n_sentences >= {SMALL} INTERSECT SELECT cluster FROM ({CENTRES}) WHERE x > -1 INTERSECT SELECT a FROM ({SIM}) WHERE a <> b AND sim > 0 INTERSECT SELECT CAST(label AS VARCHAR) FROM embeddings""")
def common_clusters(spark, sf_dir):
    labels = clustered(spark, sf_dir).select("cluster")
    return M.common_ids([sizes(spark, sf_dir).where(f"n_sentences >= {SMALL}"), C.means_2d(kept(spark, sf_dir)).where("x > -1"), similarity(spark, sf_dir).where("a <> b and sim > 0").select(F.col("a").alias("cluster")), labels], "cluster")


@query(f"""SELECT n.*, mean, p90, p99, frac_above_09 FROM (SELECT count(*) AS n, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std FROM ({ALL_UNITS})) n,
(SELECT round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.9), 6) AS p90, round(quantile_cont(sim, 0.99), 6) AS p99, round(avg(CASE WHEN sim > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS frac_above_09 FROM ({ALL_PAIRS}))""")
def embedding_quality(spark, sf_dir):
    # The row's sv1_frac has no SQL; sv1_fraction gives it.
    return E.quality(clustered(spark, sf_dir)).select("n", *r6("norm_mean", "norm_std", "mean", "p90", "p99", "frac_above_09"))


PAIRS, SEED = 5000, 42
DRAWN = f"SELECT i, a0 AS pa, CASE WHEN b0 >= a0 THEN b0 + 1 ELSE b0 END AS pb FROM (SELECT i, ((i * 2654435761 + {SEED}) % 4294967296) % n AS a0, ((i * 2246822519 + {SEED + 1}) % 4294967296) % (n - 1) AS b0 FROM range({PAIRS}) t(i), (SELECT count(*) AS n FROM ({CLUSTERED})))"


@query(f"""WITH u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) - 1 AS p, row_id, u FROM ({ALL_UNITS})) SELECT i, x.row_id AS a, y.row_id AS b, round({DOT.format(a='x.u', b='y.u')}, 6) AS sim FROM ({DRAWN}) JOIN u x ON x.p = pa JOIN u y ON y.p = pb""")
def sampled_pairs(spark, sf_dir):
    return E.sample_pairs(clustered(spark, sf_dir), PAIRS, SEED).select("i", "a", "b", *r6("sim"))


@query()
def hdbscan_grid(spark, sf_dir):
    reduced = R.pca(clustered(spark, sf_dir), 8)
    return C.hdbscan_grid(reduced, vector="reduced", grid=((1, 5, None, 0.0), (2, 10, 5, 0.0), (3, 15, None, 0.05)))


@query()
def pca_reduce(spark, sf_dir):
    return R.pca(clustered(spark, sf_dir), 32)


@query()
def reduce_set(spark, sf_dir):
    return R.reduce_set(clustered(spark, sf_dir), (8, 32, 64))


@query(f"""SELECT row_id, cluster, doc_id, sentence FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM ({CLUSTERED})) l LEFT JOIN (SELECT doc_id, text AS sentence, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents) r ON r.place = l.place""")
def columns_by_place(spark, sf_dir):
    right = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sentence"), (-F.col("doc_id")).alias("o"))
    return M.join_by_place(clustered(spark, sf_dir).select("row_id", "cluster"), right, "row_id", "o").drop("o")


@query()
def umap_reduce(spark, sf_dir):
    return R.umap(clustered(spark, sf_dir), 2)


@query()
def quick_silhouette(spark, sf_dir):
    return E.quick_silhouette(clustered(spark, sf_dir))


@query()
def sv1_fraction(spark, sf_dir):
    return E.first_singular_share(clustered(spark, sf_dir))


@query()
def embed_texts(spark, sf_dir):
    return E.embed(sentences(spark, sf_dir), "sentence").select("row_id", "embedding")


LEXICON = "CAST(len(list_filter(w, lambda x: x IN {0})) AS DOUBLE)"
COUNTED = f"SELECT row_id, {LEXICON.format(sql_list(E.POSITIVE))} AS p, {LEXICON.format(sql_list(E.NEGATIVE))} AS n FROM (SELECT row_id, string_split_regex(lower(sentence), '[^a-z]+') AS w FROM ({SENTENCES}))"


@query(f"""SELECT row_id, CASE WHEN p >= greatest(n, 0.5) THEN 'positive' WHEN n >= 0.5 THEN 'negative' ELSE 'neutral' END AS sentiment_label, round(exp(p) / (exp(p) + exp(n) + exp(0.5)), 6) AS sentiment_score_positive,
round(exp(0.5) / (exp(p) + exp(n) + exp(0.5)), 6) AS sentiment_score_neutral, round(exp(n) / (exp(p) + exp(n) + exp(0.5)), 6) AS sentiment_score_negative FROM ({COUNTED})""")
def sentiment_scores(spark, sf_dir):
    return E.sentiment(sentences(spark, sf_dir), "sentence").select("row_id", "sentiment_label", *r6("sentiment_score_positive", "sentiment_score_neutral", "sentiment_score_negative"))


@query()
def text_sample(spark, sf_dir):
    return E.sample_texts(sentences(spark, sf_dir), "sentence", 300)


@query(f"SELECT DISTINCT cluster FROM ({CLUSTERED}) ORDER BY 1")
def distinct_clusters(spark, sf_dir):
    return clustered(spark, sf_dir).select("cluster").distinct().orderBy("cluster")


ORACLE_SQL["distinct_clusters"] = f"SELECT DISTINCT cluster FROM ({CLUSTERED})"

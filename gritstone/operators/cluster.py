"""Clusters of vectors: sizes, centroids, similarities, density clustering, hierarchy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, l2_normalised
from ..session import durable, ship


def size_flag(n: Column, small: int = 150, large: int = 800) -> Column:
    return F.when(n < small, "small").when(n > large, "large").otherwise("medium")


def sizes(df: DataFrame, cluster: str = "cluster", small: int = 150, large: int = 800) -> DataFrame:
    counts = df.groupBy(cluster).agg(F.count("*").alias("n_sentences"))
    return counts.withColumn("size_flag", size_flag(F.col("n_sentences"), small, large))


def without_noise(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster).cast("string") != "-1")


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "embedding", normalise_rows: bool = False) -> DataFrame:
    """(cluster, centroid): the mean vector, or that of rows of unit length. Components are summed with partial
    aggregation; a cluster of any size is a few numbers from each task."""
    v = l2_normalised(F.col(vector)) if normalise_rows else F.col(vector)
    parts = df.select(cluster, F.posexplode(v).alias("k", "x")).groupBy(cluster, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"])
    return parts.groupBy(cluster).agg(ordered.alias("centroid"))


def means_2d(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Clusters of a tile of the similarity matrix.
SIDE = 256


def centroid_similarity(cents: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(a, b, sim) of all clusters: cosine of centroids, 1 on the diagonal. Every pair is wanted; the matrix is dealt in
    tiles of about SIDE x SIDE, so no task has more than one tile's pairs."""
    u = durable(cents.select(F.col(cluster).alias("c"), l2_normalised(F.col("centroid")).alias("u")))
    tiles = max(1, -(-u.count() // SIDE))
    u = u.withColumn("t", F.pmod(F.xxhash64("c"), F.lit(tiles)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))
    left = u.select(F.col("c").alias("a"), F.col("u").alias("ua"), F.col("t").alias("tl"), every.alias("tr"))
    right = u.select(F.col("c").alias("b"), F.col("u").alias("ub"), F.col("t").alias("tr"), every.alias("tl"))
    return left.join(right, ["tl", "tr"]).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(dot(F.col("ua"), F.col("ub"))).alias("sim"))


def summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Clusters without noise, rows assigned and not, and the share of noise (4 digits)."""
    noise = F.col(label).cast("string") == "-1"
    return df.agg(
        F.countDistinct(F.when(~noise, F.col(label))).alias("n_clusters"), F.count_if(~noise).alias("assigned"), F.count_if(noise).alias("noise"), F.bround(F.count_if(noise) / F.greatest(F.count("*"), F.lit(1)), 4).alias("noise_ratio")
    )


def representatives(df: DataFrame, per_cluster: int = 5, cluster: str = "cluster", row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """The rows nearest their cluster's centroid (mean of unit vectors): (cluster, rank, row, score_sim)."""
    from pyspark.sql import Window

    cents = centroids(df, cluster, vector, normalise_rows=True).select(F.col(cluster).alias("_c"), l2_normalised(F.col("centroid")).alias("_u"))
    scored = df.join(cents, F.col(cluster) == F.col("_c")).select(cluster, row, dot(l2_normalised(F.col(vector)), F.col("_u")).alias("score_sim"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score_sim"), row))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= per_cluster)


# ---------------------------------------------------------------- density clustering


def hdbscan(points: np.ndarray, min_cluster_size: int, min_samples: int | None = None, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) by density: mutual reachability, spanning tree, condensed tree, clusters by
    excess of mass (Campello et al., 2013). Noise is -1."""
    n = len(points)
    labels, strength = np.full(n, -1), np.zeros(n)
    k = min(n - 1, min_samples or min_cluster_size) if n else 0
    if n < max(2, min_cluster_size) or k < 1:
        return labels, strength
    square = (points**2).sum(1)
    row = lambda i: np.sqrt(np.maximum(0, square + square[i] - 2 * points @ points[i]))
    core = np.array([np.partition(row(i), k)[k] for i in range(n)])
    # Prim's tree on mutual reachability, one row of distances at a time.
    best, via, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(row(at), core), core[at])
        closer = ~inside & (d < best)
        best[closer], via[closer] = d[closer], at
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], via[nxt], nxt))
        at = nxt
    # Single linkage from the sorted tree.
    edges.sort()
    up, size, of, children, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), list(range(n)), {}, {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for m, (d, a, b) in enumerate(edges, n):
        a, b = root(a), root(b)
        up[a] = up[b] = m
        size[m], children[m], height[m] = size[a] + size[b], (a, b), d

    def leaves(x):
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            todo.extend(children[y]) if y in children else out.append(y)
        return out

    # Condense: a split counts where both sides are large enough; else points fall out.
    nodes, todo = {}, [(2 * n - 2, 0)]
    nodes[0] = {"parent": None, "birth": 0.0, "fallen": [], "kids": []}
    while todo:
        x, c = todo.pop()
        while x in children:
            a, b = children[x]
            lam = 1 / height[x] if height[x] > 0 else np.inf
            big = [y for y in (a, b) if size[y] >= min_cluster_size]
            if len(big) == 2:
                for y in big:
                    nodes[len(nodes)] = {"parent": c, "birth": lam, "fallen": [], "kids": []}
                    nodes[c]["kids"].append(len(nodes) - 1)
                    todo.append((y, len(nodes) - 1))
                nodes[c]["death"] = lam
                break
            for y in (a, b):
                if y not in big:
                    nodes[c]["fallen"] += [(p, lam) for p in leaves(y)]
            if not big:
                break
            x = big[0]
        else:
            nodes[c]["fallen"].append((x, np.inf))
    finite = lambda v: min(v, 1e12)
    members, own = {}, {}
    for c in sorted(nodes, reverse=True):
        v = nodes[c]
        below = [m for kid in v["kids"] for m in members[kid]]
        members[c] = [p for p, _ in v["fallen"]] + below
        own[c] = sum(finite(lam) - v["birth"] for _, lam in v["fallen"]) + len(below) * (finite(v.get("death", v["birth"])) - v["birth"])
    chosen, worth = {}, {}
    for c in sorted(nodes, reverse=True):
        kids = nodes[c]["kids"]
        total = sum(worth[k] for k in kids)
        close = epsilon > 0 and kids and 1 / max(1e-12, nodes[kids[0]]["birth"]) < epsilon
        if c and (not kids or own[c] >= total or close):
            chosen[c], worth[c] = [c], own[c]
        else:
            chosen[c], worth[c] = [x for k in kids for x in chosen[k]], total
    for number, c in enumerate(sorted(chosen[0])):
        lam = {}
        todo = [c]
        while todo:
            y = todo.pop()
            lam.update({p: finite(v) for p, v in nodes[y]["fallen"]})
            todo.extend(nodes[y]["kids"])
        most = max(lam.values(), default=1.0) or 1.0
        for p, v in lam.items():
            labels[p], strength[p] = number, min(1.0, v / most)
    return labels, strength


#: The usual grid: solution, smallest cluster, samples, epsilon.
GRID = ((1, 50, None, 0.0), (2, 100, None, 0.0), (3, 100, 50, 0.0), (4, 200, 100, 0.05))
#: Rows one solution may hold: its distances are worked out row by row in one task.
MOST_ROWS = 200_000


def hdbscan_grid(df: DataFrame, row: str = "row_id", vector: str = "embedding", grid=GRID) -> DataFrame:
    """(solution, row, label, prob) for each parameter set, one task each. Single-linkage clustering
    is sequential by nature, so the input is bounded: a larger one is an error and is to be reduced or
    partitioned first."""
    spark = df.sparkSession
    ship(spark)
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: cluster partitions, or representatives")
    params = {g[0]: g[1:] for g in grid}
    wide = df.select(F.explode(F.array(*[F.lit(s) for s in params])).alias("solution"), F.col(row).cast("bigint").alias("row"), F.col(vector).cast("array<double>").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        size, samples, eps = params[int(pdf["solution"].iloc[0])]
        label, prob = hdbscan(np.stack(pdf["v"].to_numpy()), size, samples, eps)
        return pd.DataFrame({"solution": pdf["solution"], "row": pdf["row"], "label": label, "prob": prob})

    return wide.groupBy("solution").applyInPandas(solve, "solution int, row bigint, label int, prob double")


def average_linkage(similarity: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Merges (step, left, right, distance, size) of average linkage on 1 - similarity, clipped to [0, 1]. Numbers below
    that of clusters are the clusters in order, later ones earlier merges. With ``labels`` (cluster,
    n_sentences, size_flag) left_label and right_label name clusters as ``id (n=..., flag)``.
    The matrix is that of clusters, a few hundred, and is merged on the driver by design."""
    rows = similarity.select("a", "b", "sim").collect()
    names = sorted({r["a"] for r in rows})
    at = {name: k for k, name in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = min(1.0, max(0.0, 1 - r["sim"]))
    d = (d + d.T) / 2
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(len(names))), [1] * len(names), []
    while len(ids) > 1:
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        out.append((len(out), ids[i], ids[j], float(d[i, j]), size[i] + size[j]))
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        keep = [k for k in range(len(ids)) if k not in (i, j)]
        d2 = np.full((len(keep) + 1, len(keep) + 1), np.inf)
        d2[:-1, :-1] = d[np.ix_(keep, keep)]
        d2[-1, :-1] = d2[:-1, -1] = merged[keep]
        d, ids, size = d2, [ids[k] for k in keep] + [len(names) + len(out) - 1], [size[k] for k in keep] + [size[i] + size[j]]
    spark = similarity.sparkSession
    merges = spark.createDataFrame(out, "step int, left int, right int, distance double, size int")
    if labels is None:
        return merges
    known = {r["cluster"]: f"{r['cluster']} (n={r['n_sentences']},{r['size_flag']})" for r in labels.select("cluster", "n_sentences", "size_flag").collect()}
    leaves = spark.createDataFrame([(k, known.get(name, str(name))) for k, name in enumerate(names)], "leaf int, label string")
    named = lambda side: leaves.select(F.col("leaf").alias(side), F.col("label").alias(f"{side}_label"))
    return merges.join(named("left"), "left", "left").join(named("right"), "right", "left").select(*merges.columns, "left_label", "right_label")

"""Merging small clusters into similar larger ones: candidates, distance filter, mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import with_places


def candidates(sizes: DataFrame, similarity: DataFrame, top: int = 3, least: float = 0.60) -> DataFrame:
    """Per small cluster its ``top`` most similar others that are not small, those below ``least`` then dropped:
    (source, target, similarity, target_size_flag, target_n_sentences)."""
    small = sizes.where("size_flag = 'small'").select(F.col("cluster").alias("source"))
    large = sizes.where("size_flag <> 'small'").select(F.col("cluster").alias("target"), F.col("size_flag").alias("target_size_flag"), F.col("n_sentences").alias("target_n_sentences"))
    pairs = similarity.select(F.col("a").alias("source"), F.col("b").alias("target"), "sim").where("source <> target and sim is not null and not isnan(sim)")
    pairs = pairs.join(small, "source").join(large, "target")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("sim"), "target"))
    kept = pairs.withColumn("r", rank).where((F.col("r") <= top) & (F.col("sim") >= least))
    return kept.select("source", "target", F.bround("sim", 4).alias("similarity"), "target_size_flag", "target_n_sentences")


def with_distance(cands: DataFrame, centres: DataFrame) -> DataFrame:
    """Candidates with the Euclidean distance of the two clusters' 2-D centres."""
    a = centres.select(F.col("cluster").alias("source"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = centres.select(F.col("cluster").alias("target"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    return cands.join(a, "source").join(b, "target").withColumn("umap_dist", d).drop("xa", "ya", "xb", "yb")


def near(cands: DataFrame, quantile: float = 0.40) -> DataFrame:
    """Candidates at most as far as the quantile of all candidates' distances."""
    edge = cands.agg(F.percentile("umap_dist", F.lit(quantile)).alias("edge"))  # one row
    return cands.join(F.broadcast(edge)).where("umap_dist <= edge").drop("edge")


def mapping(sizes: DataFrame, filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """(old_cluster, new_cluster): each small cluster to its most similar candidate, of the filtered ones or,
    where there is none at all, of the unfiltered; every other cluster to itself."""
    count = filtered.agg(F.count("*").alias("n"))
    pool = filtered.select("source", "target", "similarity").unionByName(unfiltered.select("source", "target", "similarity").join(F.broadcast(count)).where("n = 0").drop("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "target"))
    best = pool.withColumn("r", rank).where("r = 1").select(F.col("source").alias("cluster"), "target")
    return sizes.join(best, "cluster", "left").select(F.col("cluster").alias("old_cluster"), F.coalesce("target", "cluster").alias("new_cluster"))


def apply(df: DataFrame, mapped: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows with their new cluster; ids that the mapping lacks (noise) stay as they are."""
    m = mapped.select(F.col("old_cluster").alias("_old"), F.col("new_cluster").alias("_new"))
    out = df.join(m, F.col(cluster) == F.col("_old"), "left")
    return out.withColumn("cluster_merged", F.coalesce("_new", F.col(cluster))).drop("_old", "_new")


def merged_sizes(sizes: DataFrame, mapped: DataFrame) -> DataFrame:
    m = sizes.join(mapped, sizes["cluster"] == mapped["old_cluster"])
    return m.groupBy("new_cluster").agg(F.sum("n_sentences").alias("n_sentences"))


def merged_centres(centres: DataFrame, mapped: DataFrame) -> DataFrame:
    """2-D centres of merged clusters: the plain mean of the old centres, whatever their sizes."""
    m = apply(centres, mapped)
    return m.groupBy(F.col("cluster_merged").alias("cluster")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def common_ids(tables: list[DataFrame], key: str = "cluster") -> DataFrame:
    """The ids that all of the tables have."""
    out = tables[0].select(key).where(F.col(key).isNotNull()).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def join_by_place(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Columns side by side: the first row by ``left_order`` with the first by ``right_order``, and so on. Rows of the
    left without a partner have nulls; columns that both have are taken from the left."""
    l, r = with_places(left, left_order, "_place"), with_places(right, right_order, "_place")
    return l.join(r.select("_place", *[c for c in right.columns if c not in left.columns]), "_place", "left").drop("_place")

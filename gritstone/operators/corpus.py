"""Corpus statistics: token counts, document lengths, duplicate rates, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


def top_tokens(docs: DataFrame, n: int, tokens: str = "tokens", phrases: bool | None = None) -> DataFrame:
    """The most frequent tokens (ties: by token); only phrases or only single words on request."""
    counts = token_counts(docs, tokens)
    if phrases is not None:
        counts = counts.where(F.col("token").contains("_") == phrases)
    return counts.orderBy(F.desc("count"), "token").limit(n)


def ngram_share(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    c = token_counts(docs, tokens)
    phrase = F.col("token").contains("_")
    total = F.greatest(F.sum("count"), F.lit(1))
    return c.agg(F.coalesce(F.sum(F.when(~phrase, F.col("count"))), F.lit(0)).alias("unigrams"), F.coalesce(F.sum(F.when(phrase, F.col("count"))), F.lit(0)).alias("ngrams"), (F.coalesce(F.sum(F.when(phrase, F.col("count"))), F.lit(0)) / total).alias("ngram_share"))


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Documents, non-empty and empty ones, vocabulary, mean length (2 digits), and "min / P50 / P90 / P99 / max"
    lengths without decimals (half to even)."""
    lengths = docs.select(F.size(tokens).cast("double").alias("n"))
    vocabulary = docs.select(F.explode(tokens).alias("t")).agg(F.countDistinct("t").alias("vocabulary"))
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    stats = lengths.agg(
        F.count("*").alias("documents"), F.count_if(F.col("n") > 0).alias("non_empty"), F.count_if(F.col("n") == 0).alias("empty"), F.bround(F.coalesce(F.avg("n"), F.lit(0.0)), 2).alias("mean_tokens"),
        F.concat_ws(" / ", whole(F.coalesce(F.min("n"), F.lit(0.0))), whole(F.coalesce(F.get(q, 0), F.lit(0.0))), whole(F.coalesce(F.get(q, 1), F.lit(0.0))), whole(F.coalesce(F.get(q, 2), F.lit(0.0))), whole(F.coalesce(F.max("n"), F.lit(0.0)))).alias("lengths"),
    )
    return stats.join(F.broadcast(vocabulary))  # one row each


def duplicate_rate(texts: DataFrame, text: Column, after: DataFrame | None = None) -> DataFrame:
    """total, distinct texts, share of duplicates (4 digits) and, given the deduplicated table, its rows as after_dedup.
    Distinct texts are counted by hash partitions of the text, not in one set."""
    per = texts.select(text.alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_texts"))
    out = out.withColumn("duplicate_rate", F.when(F.col("total") > 0, F.bround(1 - F.col("unique_texts") / F.col("total"), 4)).otherwise(0.0))
    return out if after is None else out.join(F.broadcast(after.agg(F.count("*").alias("after_dedup"))))  # one row each


def cluster_size_stats(mapping: DataFrame, size: str = "cluster_size") -> DataFrame:
    """Over rows, so large clusters weigh more: rows, mean, median, 90th percentile, maximum."""
    q = F.percentile(size, F.array(F.lit(0.5), F.lit(0.9)))
    return mapping.agg(F.count("*").alias("count_docs"), F.avg(size).alias("mean_cluster_size"), F.get(q, 0).alias("median"), F.get(q, 1).alias("p90"), F.max(size).alias("max"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Bars of equal width between the extremes, the last closed: (bin, low, count). Empty bars are left out."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = v.join(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bar = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return at.groupBy(bar.cast("bigint").alias("bin"), (F.col("lo") + bar * width).alias("low")).agg(F.count("*").alias("count"))

"""Phrase mining: scored neighbours, greedy merging, twice for three words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import durable, ship


def safe_threshold(value: float, scoring: str = "npmi", fallback: float = 0.3) -> float:
    """An npmi threshold lies in [-1, 1]: below it is -1, above it the fallback."""
    if scoring != "npmi":
        return value
    return -1.0 if value < -1 else fallback if value > 1 else value


def adjacent_pairs(docs: DataFrame, tokens: str = "tokens", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, n): counts of neighbouring tokens. Pairs are made inside a projection and counted with
    partial aggregation, so only distinct pairs are shuffled."""
    t = F.col(tokens)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return docs.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def scored_pairs(docs: DataFrame, tokens: str = "tokens", min_count: int = 10, threshold: float = 0.3, scoring: str = "npmi", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with at least ``min_count`` occurrences that score above the threshold: (keys, a, b, n, score).

    npmi: ln(n N / (na nb)) / -ln(n / N), N all tokens; default: (n - min_count) |V| / (na nb), |V|
    distinct tokens and pairs."""
    keys = tuple(keys)
    words = docs.select(*keys, F.explode(tokens).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    pairs = adjacent_pairs(docs, tokens, keys)
    sums = words.groupBy(*keys).agg(F.sum("c").alias("all_tokens"), F.count("*").alias("kinds1"))
    kinds = pairs.groupBy(*keys).agg(F.count("*").alias("kinds2"))
    out = pairs.where(F.col("n") >= min_count)
    out = out.join(words.select(*keys, F.col("w").alias("a"), F.col("c").alias("na")), [*keys, "a"]).join(words.select(*keys, F.col("w").alias("b"), F.col("c").alias("nb")), [*keys, "b"])
    # Totals are one row, or one for each key.
    out = out.join(sums, list(keys)).join(kinds, list(keys)) if keys else out.join(F.broadcast(sums)).join(F.broadcast(kinds))
    n, a, b, total = (F.col(c).cast("double") for c in ("n", "na", "nb", "all_tokens"))
    if scoring == "npmi":
        score = F.when(n == total, F.lit(1.0)).otherwise(F.log(n * total / (a * b)) / -F.log(n / total))
    else:
        score = (n - min_count) / (a * b) * (F.col("kinds1") + F.col("kinds2"))
    return out.select(*keys, "a", "b", "n", score.alias("score")).where(F.col("score") > threshold)


def merged_tokens(tokens: list[str], accepted) -> list[str]:
    """Greedy from left to right: a token joins the one before it by ``_`` when ``accepted`` says so of the two
    and the one before is not itself a joined pair."""
    out: list[str] = []
    last = None
    for t in tokens:
        if last is not None and accepted(last, t):
            out[-1], last = f"{last}_{t}", None
        else:
            out.append(t)
            last = t
    return out


#: Pairs of a model up to which it travels to the workers whole; a larger one is met by a join.
SMALL_MODEL = 200_000


def _own_pairs(t: Column) -> Column:
    return F.array_distinct(F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))


def _merging(at: int, key_at: list[int], model: frozenset | None, out: str):
    """Batches with the merged tokens added. Without a model the last column lists each row's accepted pairs and goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, keys = [], list(zip(*(batch.column(k).to_pylist() for k in key_at), strict=True)) if key_at else [()] * batch.num_rows
            own = None if model is not None else batch.column(batch.num_columns - 1).to_pylist()
            for k, tokens in enumerate(batch.column(at).to_pylist()):
                if tokens is None:
                    merged.append(None)
                elif own is None:
                    merged.append(merged_tokens(tokens, lambda a, b, x=keys[k]: (*x, a, b) in model))
                else:
                    known = set(own[k] or ())
                    merged.append(merged_tokens(tokens, lambda a, b, known=known: f"{a} {b}" in known))
            kept = batch.columns if own is None else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(merged, pa.list_(pa.string()))], names=[*batch.schema.names[: len(kept)], out])

    return run


def merge_phrases(docs: DataFrame, pairs: DataFrame, tokens: str = "tokens", out: str = "tokens_bi", keys: tuple[str, ...] = (), id_col: str | None = None, small: int = SMALL_MODEL) -> DataFrame:
    """docs with the accepted pairs merged. A phrase model of up to ``small`` pairs, counted first, goes to the
    workers and moves no document. Beyond that it is a table: each document's own pairs meet it in an
    equi-join and come back as that document's short list. ``id_col`` names a unique column; without
    one the documents are numbered and kept in the shared folder."""
    keys = tuple(keys)
    ship(docs.sparkSession)
    pairs = durable(pairs.select(*keys, "a", "b"))
    docs = docs.select(*[c for c in docs.columns if c != out])
    at, key_at = docs.columns.index(tokens), [docs.columns.index(k) for k in keys]
    added = StructType([*docs.schema.fields, StructField(out, ArrayType(StringType()))])
    if pairs.count() <= small:
        model = frozenset(tuple(r) for r in pairs.collect())
        return docs.mapInArrow(_merging(at, key_at, model, out), added)
    accepted = pairs.select(*keys, F.concat_ws(" ", "a", "b").alias("p"))
    marked = docs if id_col else durable(docs.withColumn("_id", F.monotonically_increasing_id()))
    key = id_col or "_id"
    hits = marked.select(key, *[k for k in keys if k != key], F.explode(_own_pairs(F.col(tokens))).alias("p")).join(accepted, [*keys, "p"]).groupBy(key).agg(F.collect_list("p").alias("_m"))
    met = marked.join(hits, key, "left").select(*docs.columns, "_m")
    return met.mapInArrow(_merging(at, key_at, None, out), added)


def save_model(bigrams: DataFrame, trigrams: DataFrame, path: str) -> None:
    """A phrase model as a table: (step, keys, a, b, n, score), step 2 for pairs of tokens and 3 for pairs after merging."""
    bigrams.withColumn("step", F.lit(2)).unionByName(trigrams.withColumn("step", F.lit(3))).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    model = spark.read.parquet(path)
    return model.where("step = 2").drop("step"), model.where("step = 3").drop("step")


def apply_model(docs: DataFrame, bigrams: DataFrame, trigrams: DataFrame, tokens: str = "tokens", keys: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """tokens_bi and tokens_tri by a model made elsewhere, or earlier."""
    once = merge_phrases(docs, bigrams, tokens, "tokens_bi", keys, id_col)
    return merge_phrases(once, trigrams, "tokens_bi", "tokens_tri", keys, id_col)


def fit_model(docs: DataFrame, tokens: str = "tokens", bigram: tuple[int, float] = (10, 0.3), trigram: tuple[int, float] = (5, 0.2), scoring: str = "npmi", keys: tuple[str, ...] = (), id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of tokens that score high enough, and those among documents merged by them."""
    bi = durable(scored_pairs(docs, tokens, bigram[0], safe_threshold(bigram[1], scoring), scoring, keys))
    once = durable(merge_phrases(docs, bi, tokens, "tokens_bi", keys, id_col))
    return bi, durable(scored_pairs(once, "tokens_bi", trigram[0], safe_threshold(trigram[1], scoring, 0.2), scoring, keys))


def mine_phrases(docs: DataFrame, tokens: str = "tokens", bigram: tuple[int, float] = (10, 0.3), trigram: tuple[int, float] = (5, 0.2), scoring: str = "npmi", keys: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """Two passes: tokens_bi, then tokens_tri on the merged documents."""
    return apply_model(docs, *fit_model(docs, tokens, bigram, trigram, scoring, keys, id_col), tokens, keys, id_col)


def phrase_frequencies(docs: DataFrame, tokens: str = "tokens", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, phrase, count) of tokens with ``_``."""
    t = docs.select(*keys, F.explode(tokens).alias("phrase")).where(F.col("phrase").contains("_"))
    return t.groupBy(*keys, "phrase").agg(F.count("*").alias("count"))


def topic_phrases(docs: DataFrame, tokens: str = "tokens", topic: str = "topic_id", min_count: int = 10, thresholds: tuple[float, float] = (10.0, 8.0), top: int = 100, least: int = 20, fallback: int = 50) -> DataFrame:
    """Phrases mined within each topic by the default score: the ``top`` most frequent, and where a topic has fewer
    than ``least`` phrases, its ``fallback`` most frequent single words besides."""
    mined = mine_phrases(docs, tokens, (min_count, thresholds[0]), (min_count, thresholds[1]), "default", (topic,))
    counts = mined.select(topic, F.explode("tokens_tri").alias("phrase")).groupBy(topic, "phrase").agg(F.count("*").alias("count"))
    is_phrase = F.col("phrase").contains("_")
    per = Window.partitionBy(topic)
    counts = counts.withColumn("_n", F.sum(is_phrase.cast("int")).over(per))
    counts = counts.withColumn("_r", F.row_number().over(Window.partitionBy(topic, is_phrase).orderBy(F.desc("count"), "phrase")))
    kept = counts.where(is_phrase | ((F.col("_n") < least) & (F.col("_r") <= fallback)))
    rank = F.row_number().over(per.orderBy(F.desc("count"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select(topic, F.col("rank").cast("bigint").alias("rank"), "phrase", "count")

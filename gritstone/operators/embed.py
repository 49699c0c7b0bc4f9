"""Sentence models behind a plain interface, and measures of their quality.

Models are pluggable: an embedder or classifier is a factory that a worker calls once and that then maps
a list of texts to rows. The defaults need no weights: hashed character n-grams, and a small lexicon.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import argmax, dot, l2_normalised, norm, softmax
from ..session import durable, ship
from .tokens import with_places

Embedder = Callable[[], Callable[[list[str]], np.ndarray]]
BATCH, LEAST_BATCH = 256, 8
#: Words that tell the default sentiment.
POSITIVE = ("growth", "improve", "improved", "profit", "strong", "benefit", "success", "gain", "favorable", "opportunity")
NEGATIVE = ("loss", "decline", "adverse", "adversely", "risk", "harm", "failure", "litigation", "weak", "uncertain", "impair", "default")


def hashed_ngrams(dim: int = 64, n: int = 3) -> Embedder:
    """Unit vectors of hashed character n-grams with a sign, the same everywhere and always."""

    def load():
        # What each byte does to a CRC: a window's value is the exclusive or of its bytes' shares.
        base = zlib.crc32(bytes(n))
        share = np.array([[zlib.crc32(bytes(k) + bytes([b]) + bytes(n - 1 - k)) ^ base for b in range(256)] for k in range(n)], np.uint32)

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for k, text in enumerate(texts):
                t = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
                count = len(t) - n + 1
                if count > 0:
                    h = np.full(count, base, np.uint32)
                    for j in range(n):
                        h ^= share[j][t[j : j + count]]
                    out[k] = np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return run

    return load


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """df with a vector for each text. The model is loaded once per worker; a batch that is too large for
    memory is halved, down to LEAST_BATCH."""
    ship(df.sparkSession)
    load = embedder or hashed_ngrams()
    names, fields = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size = load(), batch
        for rows in batches:
            texts = ["" if t is None else t for t in rows.column(at).to_pylist()]
            vectors, k = [], 0
            while k < len(texts):
                try:
                    vectors.extend(np.asarray(model(texts[k : k + size]), np.float32))
                    k += size
                except MemoryError:
                    if size <= LEAST_BATCH:
                        raise
                    size = max(LEAST_BATCH, size // 2)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")


def sentiment(df: DataFrame, text: str, logits=None) -> DataFrame:
    """df with sentiment_label and the three scores. ``logits`` may give an array column in the order positive,
    negative, neutral; by default a lexicon does, in generated code."""
    if logits is None:
        words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+")
        count = lambda entries: F.size(F.filter(words, lambda w: w.isin(*entries))).cast("double")
        logits = F.array(count(POSITIVE), count(NEGATIVE), F.lit(0.5))
    out = df.withColumn("_p", softmax(logits)).withColumn("_k", argmax(F.col("_p")))
    label = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), F.col("_k") + 1)
    return out.select(*df.columns, label.alias("sentiment_label"), F.get("_p", 0).alias("sentiment_score_positive"), F.get("_p", 2).alias("sentiment_score_neutral"), F.get("_p", 1).alias("sentiment_score_negative"))


def sample_texts(df: DataFrame, text: str, n: int = 3000, seed: int = 42) -> DataFrame:
    """Distinct non-blank texts with the smallest seeded hashes: a sample that is the same on every run."""
    t = df.select(F.trim(text).alias(text)).where(F.col(text) != "").distinct()
    return t.orderBy(F.xxhash64(text, F.lit(seed)), text).limit(n)


# ---------------------------------------------------------------- measures over all rows

#: Rows of a block: the similarities of two blocks are 8 MB.
BLOCK = 1024
#: Similarities are ranked as whole numbers of 48 bits in steps of 2 ** -46, 16 bits in a pass.
_STEPS, _BINS = 2.0**46, 1 << 16


def _block_pairs(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(l, a, ua, r, b, ub): every block of rows beside every block, ids in order and unit vectors. Rows
    of one id are in one block."""
    u = df.where(F.col(vector).isNotNull()).select(F.col(row).alias("row"), l2_normalised(F.col(vector)).alias("u"))
    u = durable(u)
    blocks = max(1, -(-u.count() // BLOCK))
    x = u.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("l")).agg(F.array_sort(F.collect_list(F.struct("row", "u"))).alias("x"))
    left = durable(x.select("l", F.col("x.row").alias("a"), F.col("x.u").alias("ua")))
    return left.crossJoin(left.toDF("r", "b", "ub"))


def _unit_vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.array(x.values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x.values), -1)) for x in column]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray | None]]:
    """(a, ua, b, ub, same): same is where ids are equal, None for two different blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            a, b = one.column(1)[0].values, one.column(4)[0].values
            same = None
            if one.column(0)[0] == one.column(3)[0]:
                code = a.dictionary_encode().indices.to_numpy()
                same = code[:, None] == code[None, :]
            yield a, _unit_vectors(one.column(2))[0], b, _unit_vectors(one.column(5))[0], same


def _counted_sims(prefixes: list[int] | None, shift: int):
    """Per partition: for each prefix (None: all) how many similarities fall in each bin of the next 16 bits; with
    bin -1 the sum of all similarities and how many are above 0.9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(prefixes or [0]), _BINS), np.int64)
        total, above = 0.0, 0
        for _, u, _, v, same in _units(batches):
            sims = u @ v.T
            sims = sims.ravel() if same is None else sims[np.triu(~same)]
            total, above = total + float(sims.sum()), above + int((sims > 0.9).sum())
            codes = np.clip((np.nan_to_num(sims, nan=2.0) + 2) * _STEPS, 0, 4 * _STEPS - 1).astype(np.int64)
            for k, prefix in enumerate(prefixes or [0]):
                part = codes if prefixes is None else codes[codes >> (shift + 16) == prefix]
                counts[k] += np.bincount((part >> shift) & (_BINS - 1), minlength=_BINS)
        which, at = np.nonzero(counts)
        columns = [np.r_[which, 0], np.r_[at, -1], np.r_[counts[which, at], above], np.r_[np.zeros(len(at)), total]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["which", "bin", "n", "total"])

    return run


def pairwise_stats(df: DataFrame, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Count, mean, percentiles and share above 0.9 of the similarities of all pairs of rows. Pairs are
    counted by bins in three passes over blocks, never listed, which gives percentiles to 2 ** -46."""
    spark = df.sparkSession
    ship(spark)
    pairs = _block_pairs(df, row, vector).where("l <= r")

    def counted(prefixes, shift):
        found = pairs.mapInArrow(_counted_sims(prefixes, shift), "which bigint, bin bigint, n bigint, total double")
        return found.groupBy("which", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("which", "bin").toArrow().to_pydict()

    schema = "pairs bigint, mean double, p90 double, p99 double, frac_above_09 double"
    first = counted(None, 32)
    rows = list(zip(first["which"], first["bin"], first["n"], first["total"], strict=True))
    n = sum(x[2] for x in rows if x[1] >= 0)
    if not n:
        return spark.createDataFrame([(0, None, None, None, None)], schema)
    _, _, above, total = next(x for x in rows if x[1] < 0)
    # Each target is a rank from zero among the pairs whose code begins with its prefix.
    where = [q * (n - 1) for q in (0.9, 0.99)]
    targets = [(0, int(r)) for h in where for r in (np.floor(h), np.ceil(h))]
    prefixes = [0]
    for shift in (32, 16, 0):
        if shift < 32:
            prefixes = sorted({p for p, _ in targets})
            found = counted(prefixes, shift)
            rows = list(zip(found["which"], found["bin"], found["n"], found["total"], strict=True))
        bins = {p: ([x[1] for x in rows if x[0] == k and x[1] >= 0], np.cumsum([x[2] for x in rows if x[0] == k and x[1] >= 0])) for k, p in enumerate(prefixes)}
        for k, (p, rank) in enumerate(targets):
            at = int(np.searchsorted(bins[p][1], rank, "right"))
            targets[k] = (p << 16 | bins[p][0][at], rank - (int(bins[p][1][at - 1]) if at else 0))
    value = [p / _STEPS - 2 for p, _ in targets]
    p90, p99 = (low + (high - low) * (h - np.floor(h)) for h, low, high in zip(where, value[::2], value[1::2], strict=True))
    return spark.createDataFrame([(n, total / n, float(p90), float(p99), above / n)], schema)


def _nearest_in_units(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, u, b, v, same in _units(batches):
            sims = u @ v.T
            if same is not None:
                sims[same] = -np.inf
            one, other, scores = [], [], []
            for q in range(len(u)):
                s = sims[q]
                at = np.flatnonzero(s >= (np.partition(s, -k)[-k] - 1e-9 if len(s) > k else -2))
                # Scored again row by row, so that equal vectors tie whatever their block.
                exact = (u[q] * v[at]).sum(axis=1)
                best = np.lexsort((at, -exact))[:k]
                one.append(np.full(len(best), q))
                other.append(at[best])
                scores.append(exact[best])
            one, other = pa.array(np.concatenate(one)), pa.array(np.concatenate(other))
            yield pa.RecordBatch.from_arrays([a.take(one), b.take(other), pa.array(np.concatenate(scores))], names=["a", "b", "sim"])

    return run


def nearest(df: DataFrame, k: int, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(a, b, sim, r): the k most similar others of each row, ties by b. Every block of rows is searched for
    every row; a row brings k candidates from each."""
    ship(df.sparkSession)
    kind = df.schema[row].dataType.simpleString()
    found = _block_pairs(df, row, vector).mapInArrow(_nearest_in_units(k), f"a {kind}, b {kind}, sim double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k)


def knn_stats(df: DataFrame, ks: tuple[int, ...] = (1, 5, 10), row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Per k the mean and 90th percentile over all k-nearest similarities together."""
    near = nearest(df, max(ks), row, vector).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("r <= k")
    return near.groupBy("k").agg(F.avg("sim").alias("mean"), F.percentile("sim", F.lit(0.9)).alias("p90"))


def transfer(df: DataFrame, other: DataFrame, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """How similar the nearest neighbours under one embedding are under another."""
    near = nearest(df, 1, row, vector)
    u = other.select(F.col(row).alias("row"), l2_normalised(F.col(vector)).alias("u"))
    s = near.join(u.select(F.col("row").alias("a"), F.col("u").alias("ua")), "a").join(u.select(F.col("row").alias("b"), F.col("u").alias("ub")), "b")
    q = F.percentile("s", F.array(F.lit(0.9), F.lit(0.99)))
    return s.select(dot(F.col("ua"), F.col("ub")).alias("s")).agg(F.avg("s").alias("mean"), F.get(q, 0).alias("p90"), F.get(q, 1).alias("p99"))


def norms(df: DataFrame, vector: str = "embedding") -> DataFrame:
    n = df.select(norm(F.col(vector)).alias("n"))
    return n.agg(F.count("*").alias("n"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"))


def first_singular_share(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """First singular value of the centred matrix over the sum of all."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    d = df.select(F.size(vector).alias("d")).first()["d"]
    values = np.sqrt(np.maximum(0, PCA(k=d, inputCol="features", outputCol="o").fit(rows).explainedVariance.toArray()))
    return df.sparkSession.createDataFrame([(float(values[0] / (values.sum() + 1e-9)),)], "sv1_frac double")


def quality(df: DataFrame, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """One row on a model's vectors: n, norm_mean, norm_std, sv1_frac, pairs, mean, p90, p99, frac_above_09."""
    parts = [norms(df, vector), first_singular_share(df, vector), pairwise_stats(df, row, vector)]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each


def sample_pairs(df: DataFrame, pairs: int = 2_000_000, seed: int = 42, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(i, a, b, sim) of ``pairs`` pairs of different rows drawn with replacement, the same on every run: places among
    the rows in order come from two multiplicative hashes of the draw's number."""
    spark = df.sparkSession
    placed = durable(with_places(df.select(F.col(row).alias("row"), l2_normalised(F.col(vector)).alias("u")), "row", "p"))
    n = placed.count()
    if n < 2:
        return spark.createDataFrame([], f"i bigint, a {df.schema[row].dataType.simpleString()}, b {df.schema[row].dataType.simpleString()}, sim double")
    drawn = lambda factor, shift, most: (F.col("i") * factor + shift) % (1 << 32) % most
    d = spark.range(pairs).select(F.col("id").alias("i")).withColumn("pa", drawn(2654435761, seed, n)).withColumn("pb", drawn(2246822519, seed + 1, n - 1))
    d = d.withColumn("pb", F.when(F.col("pb") >= F.col("pa"), F.col("pb") + 1).otherwise(F.col("pb")))
    one, other = placed.select(F.col("p").alias("pa"), F.col("row").alias("a"), F.col("u").alias("ua")), placed.select(F.col("p").alias("pb"), F.col("row").alias("b"), F.col("u").alias("ub"))
    return d.join(one, "pa").join(other, "pb").select("i", "a", "b", dot(F.col("ua"), F.col("ub")).alias("sim"))


def quick_silhouette(df: DataFrame, k: int = 10, seed: int = 42, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Cosine silhouette of labels from a seeded projection to eight dimensions: the sum of floored
    z-scores, mod k. Null where there are fewer than two labels."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(F.col(row).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    d = vectors.select(F.size("v").alias("d")).first()["d"]
    axes = np.random.default_rng(seed).normal(size=(8, d))
    cols = [dot(F.col("v"), F.array(*[F.lit(float(x)) for x in axis])).alias(f"p{i}") for i, axis in enumerate(axes)]
    p = vectors.select("row", "v", *cols)
    stats = p.agg(*[F.avg(f"p{i}").alias(f"m{i}") for i in range(8)], *[F.stddev_pop(f"p{i}").alias(f"s{i}") for i in range(8)]).first()
    total = sum((F.floor((F.col(f"p{i}") - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-6)) for i in range(8)), F.lit(0))
    labelled = p.select(array_to_vector("v").alias("features"), F.pmod(F.abs(total), F.lit(k)).cast("int").alias("prediction"))
    value = float(ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine").evaluate(labelled)) if labelled.select("prediction").distinct().count() > 1 else None
    return df.sparkSession.createDataFrame([(value,)], "silhouette double")

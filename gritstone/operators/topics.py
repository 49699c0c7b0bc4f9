"""Topic models: dictionary, LDA, coherence, model choice, interpretation, labels."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import argmax
from ..session import discard, durable, ship
from .tokens import LABEL_STOPS, label_terms


def dictionary(docs: DataFrame, tokens: str = "tokens", min_docs: int = 20, max_share: float = 0.4, keep: int = 50_000) -> DataFrame:
    """(token, df): tokens in at least ``min_docs`` and at most ``max_share`` of the documents, the ``keep`` most
    widespread (ties: by token)."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    kept = df.join(F.broadcast(n)).where((F.col("df") >= min_docs) & (F.col("df") <= max_share * F.col("n"))).drop("n")
    return kept.orderBy(F.desc("df"), "token").limit(keep)


def in_dictionary(docs: DataFrame, vocab: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """Documents with only the dictionary's tokens, in order; those left without any are dropped."""
    t = docs.select(id_col, F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token"), "token")
    return t.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias(tokens))


def weighted_counts(docs: DataFrame, tokens: str = "tokens", min_docs: int = 20, max_share: float = 0.4, vocab_size: int = 50_000):
    """(vocabulary, documents with counts weighted by inverse document frequency). Both the documents and their weights are
    written, as every iteration of a model reads them again."""
    from pyspark.ml.feature import IDF, CountVectorizer

    docs = durable(docs)
    # From 1 on the vectorizer would take the limit for a number of documents.
    most = max_share if max_share < 1 else float(2**53)
    cv = CountVectorizer(inputCol=tokens, outputCol="_tf", minDF=float(min_docs), maxDF=most, vocabSize=vocab_size).fit(docs)
    counted = cv.transform(docs)
    return cv.vocabulary, durable(IDF(inputCol="_tf", outputCol="features").fit(counted).transform(counted).drop("_tf"))


def _digamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel().tolist()]).reshape(x.shape)


def _trigamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _expectation(x: np.ndarray) -> np.ndarray:
    """Mean logarithms of Dirichlet variables, one in each row."""
    return _digamma(x) - _digamma(x.sum(1, keepdims=True))


#: A task of a sweep has about so many numbers to multiply. Models fitted side by side have so many numbers at most, and so many
#: for their documents' shares; a model beyond that is fitted alone. So many fits go on at a time.
WORK, MODEL, SHARES, FITS = 1 << 25, 1 << 20, 1 << 22, 8
#: Numbers in an array of a sweep.
CHUNK = 1 << 19
#: Shares below this are as good as none; their products are still normal numbers of single precision.
LEAST = 1e-18


def _bytes(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """Numbers of 4 bytes as binary values of so many of them."""
    ends = np.append(0, np.cumsum(size) * 4).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """All numbers of 4 bytes in a binary column."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    return np.frombuffer(column.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // 4, ends[0])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features to (words, n), as bytes, which Spark copies whole; those without words are dropped."""
    for batch in batches:
        f = batch["features"]
        f = f.filter(pc.greater(pc.fill_null(pc.list_value_length(f.field("indices")), 0), 0))
        size = pc.list_value_length(f.field("indices")).to_numpy(zero_copy_only=False)
        word, n = (f.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
        yield pa.RecordBatch.from_arrays([_bytes(word.astype(np.int32), size), _bytes(n.astype(np.float32), size)], names=["words", "n"])


def bags(weighted: DataFrame) -> tuple[DataFrame, int, int]:
    """What a fit reads of the weighted documents: (words, n), written, the number of documents and that of their different words."""
    ship(weighted.sparkSession)
    table = durable(weighted.select("features").mapInArrow(_flat, "words binary, n binary"))
    r = table.agg(F.count("*").alias("documents"), F.sum(F.length("words")).alias("bytes")).first()
    return table, r["documents"], (r["bytes"] or 0) // 4


def _log_shares(x: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Mean logarithms of Dirichlet variables, one of each model in each row."""
    return _digamma(x) - np.repeat(_digamma(np.add.reduceat(x, np.cumsum(ks) - ks, axis=1)), ks, axis=1)


def _sweep(sent, ks: np.ndarray):
    """Documents (words, n, gamma) to the same after a step of each model, and a row (sums) for the task: the words' weights in
    the topics, below them the documents' mean logarithms and their number."""
    width, at, model = int(ks.sum()), np.cumsum(ks) - ks, np.repeat(np.arange(len(ks)), ks)

    def step(word, n, size, gamma, beta, alpha, sums):
        log_theta = _log_shares(gamma, ks)
        sums[-2] += log_theta.sum(0)
        p = beta[word]
        p *= np.maximum(np.exp(log_theta), np.float32(LEAST))[np.repeat(np.arange(len(size)), size)]
        p *= np.take(n[:, None] / np.add.reduceat(p, at, axis=1), model, axis=1)
        ends = np.cumsum(size)
        if width > 256:  # long rows: a document at a time
            for i, end in enumerate(ends.tolist()):
                own = slice(end - size[i], end)
                sums[word[own]] += p[own]  # its words are different
                p[own].sum(0, out=gamma[i])
            return gamma + alpha
        order = np.argsort(word.astype(np.uint16) if len(beta) <= 1 << 16 else word, kind="stable")
        first = np.flatnonzero(np.diff(word[order], prepend=-1))
        sums[word[order[first]]] += np.add.reduceat(p[order], first, axis=0)
        return np.add.reduceat(p, ends - size, axis=0) + alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha = sent.value
        sums = np.zeros((len(beta) + 2, width), np.float32)
        for batch in batches:
            size, stored = pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False) // 4, "gamma" in batch.schema.names
            word, n = _numbers(batch["words"], np.int32), _numbers(batch["n"], np.float32)
            before = _numbers(batch["gamma"], np.float32).reshape(-1, width) if stored else np.ones((1, width), np.float32)
            ends = np.cumsum(size)
            done, out = 0, []
            while done < len(size):
                start = ends[done - 1] if done else 0
                more = max(done + 1, int(np.searchsorted(ends, start + CHUNK // width, "right")))
                gamma = before[done:more].copy() if stored else np.repeat(before, more - done, axis=0)
                out.append(step(word[start : ends[more - 1]], n[start : ends[more - 1]], size[done:more], gamma, beta, alpha, sums))
                done = more
            sums[-1] += len(size)
            gammas = _bytes(np.concatenate(out) if out else before[:0], np.full(len(size), width))
            yield pa.RecordBatch.from_arrays([batch["words"], batch["n"], gammas, pa.nulls(len(size), pa.binary())], names=["words", "n", "gamma", "sums"])
        if sums[-1, 0]:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.binary())] * 3, pa.array([sums.tobytes()], pa.binary())], names=["words", "n", "gamma", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition to one."""
    total = None
    for batch in batches:
        for x in batch["sums"].to_pylist():
            x = np.frombuffer(x, np.float32)
            total = x.astype(float) if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])


def _newton(alpha: np.ndarray, mean_log: np.ndarray, weight: float) -> np.ndarray:
    """The concentrations after a part of Newton's step towards the documents' mean logarithms, as in the library; where
    it would leave the positive numbers, as they were."""
    grad, c, q = mean_log - _digamma(alpha) + _digamma(alpha.sum(keepdims=True)), _trigamma(alpha.sum(keepdims=True)), -_trigamma(alpha)
    new = alpha - weight * (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    return new if (new > 0).all() else alpha


class Fit:
    """Models for each of ``ks``, fitted side by side. A sweep reads every document and moves its shares by one variational
    step, then moves the topics. Documents' shares are written with each sweep, so a fit goes on from where it stopped."""

    def __init__(self, documents: tuple[DataFrame, int, int], words: int, ks: tuple[int, ...], seed: int = 42):
        table, self.documents, entries = documents
        self.ks, self.seed, self.sweeps = np.array(ks), seed, 0
        # Each word costs something besides its topics, and each task writes sums as large as the topics.
        self.tasks = max(min(-(-entries * (int(self.ks.sum()) + 64) // WORK), entries // (8 * words)), 1)
        self.state, self.own = table.repartition(self.tasks), False
        # A model does not depend on which others are fitted beside it.
        self.topics = [np.random.default_rng([seed, k]).gamma(100, 1 / 100, (k, words)) for k in ks]
        self.alpha = [np.full(k, 1 / k) for k in ks]

    def go_on(self, sweeps: int) -> Fit:
        for _ in range(sweeps):
            self._sweep()
        return self

    def _sweep(self) -> None:
        sc = self.state.sparkSession.sparkContext
        beta = np.concatenate([np.maximum(np.exp(_expectation(x)), LEAST) for x in self.topics]).T.astype(np.float32, order="C")
        sent = sc.broadcast((beta, np.concatenate(self.alpha).astype(np.float32)))  # bounded by the vocabulary, not by the documents
        new = durable(self.state.mapInArrow(_sweep(sent, self.ks), "words binary, n binary, gamma binary, sums binary"), "none")
        sent.destroy()
        sums, n = new.where("sums is not null").select("sums"), self.tasks
        while n > 8:
            n = math.isqrt(n)
            sums = sums.repartition(n).mapInArrow(_added, "sums binary")
        total = np.zeros(len(beta) * beta.shape[1] + 2 * beta.shape[1])
        for x in sums.toArrow()["sums"]:
            total += np.frombuffer(x.as_buffer(), np.float32)
        total = total.reshape(-1, beta.shape[1])
        if self.own:
            discard(self.written)
        self.written, self.own = new, True
        self.state = new.where("gamma is not null").select("words", "n", "gamma")
        self.sweeps += 1
        ends = np.cumsum(self.ks)
        for i, (k, end) in enumerate(zip(self.ks.tolist(), ends.tolist(), strict=True)):
            own = total[:, end - k : end]
            self.topics[i] = 1 / k + own[:-2].T
            self.alpha[i] = _newton(self.alpha[i], own[-2] / self.documents, (1024 + self.sweeps) ** -0.51)

    def end(self) -> None:
        if self.own:
            discard(self.written)
            self.own = False

    def model(self, i: int = 0):
        """The library's model of the topics as they are."""
        from pyspark.ml.clustering import LDA, LocalLDAModel
        from pyspark.mllib.common import _py2java
        from pyspark.mllib.linalg import DenseMatrix, Vectors

        spark, k, x = self.state.sparkSession, int(self.ks[i]), self.topics[i]
        jvm = spark.sparkContext._jvm.org.apache.spark
        inner = jvm.mllib.clustering.LocalLDAModel(*[_py2java(spark.sparkContext, v) for v in (DenseMatrix(x.shape[1], k, x.ravel()), Vectors.dense(self.alpha[i]))], 1 / k, 100.0)
        estimator = LDA(k=k, maxIter=self.sweeps, seed=self.seed, featuresCol="features")
        return estimator._copyValues(LocalLDAModel(jvm.ml.clustering.LocalLDAModel(estimator.uid, x.shape[1], inner, spark._jsparkSession)))


def fit_lda(docs: DataFrame, k: int, iterations: int = 50, seed: int = 42, tokens: str = "tokens", min_docs: int = 20, max_share: float = 0.4, vocab_size: int = 50_000, prepared=None):
    """LDA on counts weighted by inverse document frequency; each iteration takes all documents. Returns (model, vocabulary,
    weighted documents); ``prepared`` is what weighted_counts has given before."""
    vocab, weighted = prepared or weighted_counts(docs, tokens, min_docs, max_share, vocab_size)
    fit = Fit(bags(weighted), len(vocab), (k,), seed).go_on(iterations)
    fit.end()
    return fit.model(), vocab, weighted


def _shares(beta: np.ndarray, n: np.ndarray, begin: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The variational parameters of documents whose words, from ``begin`` on, have rows of ``beta`` and counts ``n``; a
    document rests once its parameters move by less than 0.001 on average, as in the library."""
    gamma = np.ones((len(begin), len(alpha)))
    size = np.diff(np.append(begin, len(n)))
    live = np.arange(len(begin))
    while len(live):
        row = np.repeat(np.arange(len(live)), size)
        begin = np.cumsum(size) - size
        g, resting = gamma[live], np.zeros(len(live), bool)
        while resting.sum() * 8 <= len(live) and not resting.all():
            theta = np.exp(_expectation(g))
            new = theta * np.add.reduceat(beta * (n / (np.einsum("ij,ij->i", theta[row], beta) + 1e-100))[:, None], begin) + alpha
            moved = np.abs(new - g).mean(1) > 1e-3
            g = np.where(resting[:, None], g, new)
            resting |= ~moved
        gamma[live] = g
        of_live = ~resting[row]
        beta, n, live, size = beta[of_live], n[of_live], live[~resting], size[~resting]
    return gamma


def _bound(sent):
    """Documents' features to (bound, n): their part of the evidence bound, and their counts' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_beta, alpha = sent.value
        beta = np.exp(log_beta)
        for batch in batches:
            f = batch["features"]
            size = pc.fill_null(pc.list_value_length(f.field("indices")), 0).to_numpy(zero_copy_only=False)
            word, n = f.field("indices").flatten().to_numpy(zero_copy_only=False), f.field("values").flatten().to_numpy(zero_copy_only=False)
            size = size[size > 0]
            total = 0.0
            if len(size):
                begin = np.cumsum(size) - size
                gamma = _shares(beta[word], n, begin, alpha)
                log_theta = _expectation(gamma)
                terms = np.repeat(log_theta, size, axis=0) + log_beta[word]
                top = terms.max(1, keepdims=True)
                total = (n * (np.log(np.exp(terms - top).sum(1)) + top[:, 0])).sum() + ((alpha - gamma) * log_theta).sum() + (_lgamma(gamma) - _lgamma(alpha)).sum() + (math.lgamma(alpha.sum()) - _lgamma(gamma.sum(1))).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64()), pa.array([float(n.sum())], pa.float64())], names=["bound", "n"])

    return run


def perplexity(model, weighted: DataFrame) -> float:
    """exp of the library's logPerplexity on sparse features, with documents inferred many at a time."""
    spark = weighted.sparkSession
    ship(spark)
    topics, alpha = model.topicsMatrix().toArray().T, np.array(model.estimatedDocConcentration())
    eta = model.getTopicConcentration() if model.isSet("topicConcentration") else 1 / len(topics)
    log_beta = _expectation(topics)
    part = ((eta - topics) * log_beta).sum() + (_lgamma(topics) - math.lgamma(eta)).sum() + (math.lgamma(eta * topics.shape[1]) - _lgamma(topics.sum(1))).sum()
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(log_beta.T), alpha))  # vocab_size rows at most
    r = weighted.select("features").mapInArrow(_bound(sent), "bound double, n double").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n")).first()
    return math.exp(-(r["bound"] + part) / r["n"])


def fit_until_settled(docs: DataFrame, k: int, most: int = 1000, step: int = 50, patience: int = 150, **options):
    """Go on for at most ``most`` iterations, ``step`` at a time, until the perplexity has not improved for ``patience`` of
    them. Returns (model, vocabulary, weighted, iterations) of the best."""
    best = None
    seed = options.pop("seed", 42)
    vocab, weighted = weighted_counts(docs, **options)
    fit = Fit(bags(weighted), len(vocab), (k,), seed)
    while fit.sweeps < most:
        model = fit.go_on(min(step, most - fit.sweeps)).model()
        p = perplexity(model, weighted)
        if best is None or p < best[0] - 1e-9:
            best = (p, fit.sweeps, model)
        elif fit.sweeps - best[1] >= patience:
            break
    fit.end()
    return best[2], vocab, weighted, best[1]


def top_words(model, vocab: list[str], n: int = 30) -> DataFrame:
    """(topic_id, rank, word, prob)."""
    d = model.describeTopics(n)
    words = F.array(*[F.lit(w) for w in vocab]) if len(vocab) <= 2000 else None
    rows = d.select(F.col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    rows = rows.select("topic_id", (F.col("rank") + 1).alias("rank"), F.col("x.termIndices").alias("term"), F.col("x.termWeights").alias("prob"))
    if words is not None:
        return rows.select("topic_id", "rank", F.element_at(words, F.col("term") + 1).alias("word"), "prob")
    names = d.sparkSession.createDataFrame(list(enumerate(vocab)), "term int, word string")
    return rows.join(names, "term").select("topic_id", "rank", "word", "prob")


def document_topics(model, weighted: DataFrame, id_col: str) -> DataFrame:
    """(id, theta, dominant_topic, dominant_prob)."""
    from pyspark.ml.functions import vector_to_array

    return with_dominant(model.transform(weighted).select(id_col, vector_to_array("topicDistribution").alias("theta")))


def with_dominant(df: DataFrame, theta: str = "theta") -> DataFrame:
    return df.withColumn("dominant_topic", argmax(F.col(theta))).withColumn("dominant_prob", F.array_max(theta))


def topic_summary(thetas: DataFrame, k: int, words: DataFrame | None = None) -> DataFrame:
    """(topic_id, dom_doc_count, mean_theta) and top10_words where given; topics without documents count zero."""
    spark = thetas.sparkSession
    ids = spark.range(k).select(F.col("id").cast("int").alias("topic_id"))
    dominant = thetas.groupBy(F.col("dominant_topic").alias("topic_id")).agg(F.count("*").alias("dom_doc_count"))
    mean = thetas.select(F.posexplode("theta").alias("topic_id", "p")).groupBy("topic_id").agg(F.avg("p").alias("mean_theta"))
    out = ids.join(dominant, "topic_id", "left").join(mean, "topic_id", "left").select("topic_id", F.coalesce("dom_doc_count", F.lit(0)).alias("dom_doc_count"), F.coalesce("mean_theta", F.lit(0.0)).alias("mean_theta"))
    if words is not None:
        ten = words.where("rank <= 10").groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("top10_words"))
        out = out.join(ten, "topic_id", "left")
    return out


def top_bottom_samples(thetas: DataFrame, id_col: str, top: int = 50, bottom: int = 50) -> DataFrame:
    """(topic_id, which, rank, id, prob): the documents with the largest and the smallest share of each topic. The
    smallest are taken among positive shares where there are at least ``bottom`` of those, else among all."""
    long = thetas.select(id_col, F.posexplode("theta").alias("topic_id", "prob"))
    best = long.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("prob"), id_col))).where(F.col("rank") <= top)
    positive = long.groupBy("topic_id").agg(F.count_if(F.col("prob") > 0).alias("_n"))
    pool = long.join(F.broadcast(positive), "topic_id").where((F.col("_n") < bottom) | (F.col("prob") > 0)).drop("_n")  # a row for each topic
    worst = pool.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy("prob", id_col))).where(F.col("rank") <= bottom)
    named = lambda d, which: d.select(F.col("topic_id").cast("bigint").alias("topic_id"), F.lit(which).alias("which"), F.col("rank").cast("bigint").alias("rank"), id_col, "prob")
    return named(best, "top").unionByName(named(worst, "bottom"))


def top_documents(thetas: DataFrame, id_col: str, n: int = 2000) -> DataFrame:
    """(topic_id, rank, id, prob): the ``n`` documents with the largest share of each topic."""
    long = thetas.select(id_col, F.posexplode("theta").alias("topic_id", "prob"))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("prob"), id_col))
    return long.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("topic_id").cast("bigint").alias("topic_id"), F.col("rank").cast("bigint").alias("rank"), id_col, "prob")


def smart_merge(doc_topics: DataFrame, original: DataFrame, keys: tuple[tuple[str, ...], ...] = (("doc_id", "sent_id"), ("orig_row",)), order: str | None = None) -> DataFrame:
    """Each document with its original row: joined on the first set of keys that both tables have. Of original
    rows with equal keys the first by ``order`` counts. Rows have no places in a distributed table, so
    without common keys this is an error."""
    key = next((list(k) for k in keys if set(k) <= set(doc_topics.columns) & set(original.columns)), None)
    if key is None:
        raise ValueError(f"none of {keys} in both tables")
    rest = [c for c in original.columns if c not in key and c not in doc_topics.columns]
    by = F.col(order) if order else F.struct(*rest)
    first = original.groupBy(*key).agg(F.min(F.struct(by.alias("o"), F.struct(*rest).alias("v")))["v"].alias("_v"))
    return doc_topics.join(first, key, "left").select(*doc_topics.columns, *[F.col(f"_v.{c}").alias(c) for c in rest])


def aligned_texts(docs: DataFrame, original: DataFrame, row: str, orig_row: str, text: str, order: str | None = None) -> DataFrame:
    """docs with the text of the original row that each names."""
    first = original.groupBy(F.col(orig_row).alias("_row")).agg(F.min_by(text, order or text).alias("text"))
    return docs.join(first, F.col(row) == F.col("_row"), "left").drop("_row")


def _side_by_side(ks: tuple[int, ...], words: int, documents: int, fits: int) -> list[tuple[int, ...]]:
    """All of the ks, in groups of models to be fitted side by side."""
    most = min(MODEL // max(words, 1), SHARES // max(documents, 1), -(-sum(ks) // fits) + max(ks, default=0))
    groups: list[tuple[int, ...]] = []
    for k in ks:
        if groups and sum(groups[-1]) + k <= most:
            groups[-1] += (k,)
        else:
            groups.append((k,))
    return groups


def lda_grid(docs: DataFrame, ks: tuple[int, ...], id_col: str, iterations: int = 50, top: int = 15, **options) -> DataFrame:
    """(K, perplexity, coherence_c_v) of a model for each K; c_v is the mean over its topics."""
    seed = options.pop("seed", 42)
    vocab, weighted = weighted_counts(docs, **options)
    spark, read = weighted.sparkSession, bags(weighted)
    fits = min(FITS, spark.sparkContext.defaultParallelism)

    def fitted(group: tuple[int, ...]) -> list[tuple[int, float, list[list[str]]]]:
        fit = Fit(read, len(vocab), group, seed).go_on(iterations)
        fit.end()
        return [(k, perplexity(fit.model(i), weighted), [[vocab[w] for w in np.argsort(-x, kind="stable")[:top]] for x in fit.topics[i]]) for i, k in enumerate(group)]

    pool = ThreadPoolExecutor(fits)
    try:
        models = [m for found in pool.map(fitted, _side_by_side(ks, len(vocab), read[1], fits)) for m in found]
    finally:
        pool.shutdown(cancel_futures=True)
    owner = [n for n, (_, _, topics) in enumerate(models) for _ in topics]
    words = [(t, w) for t, topic in enumerate(topic for *_, topics in models for topic in topics) for w in topic]
    scores: list[list[float]] = [[] for _ in models]
    for r in coherence_cv(weighted, spark.createDataFrame(words, "topic_id long, word string"), id_col).collect():
        scores[owner[r["topic_id"]]].append(r["c_v"])
    rows = [(k, p, math.fsum(c) / len(c) if c else None) for (k, p, _), c in zip(models, scores, strict=True)]
    return spark.createDataFrame(rows, "K int, perplexity double, coherence_c_v double")


def _covered(places: list[int], window: int, last: int) -> list[tuple[int, int]]:
    """Disjoint intervals (first, last) of the starts of windows that hold any of the places."""
    out: list[tuple[int, int]] = []
    for p in places:
        low, high = max(p - window + 1, 0), min(p, last)
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        elif low <= high:
            out.append((low, high))
    return out


def _common(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> int:
    """How many starts two lists of intervals have in common."""
    i = j = n = 0
    while i < len(x) and j < len(y):
        n += max(0, min(x[i][1], y[j][1]) - max(x[i][0], y[j][0]) + 1)
        if x[i][1] < y[j][1]:
            i += 1
        else:
            j += 1
    return n


def _window_counts(together: dict[str, set[str]], window: int):
    """Documents' tokens to (a, b, n): windows that hold both words, for words that stand in one topic; a = b counts one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                places: dict[str, list[int]] = {}
                for k, word in enumerate(tokens or ()):
                    if word in together:
                        places.setdefault(word, []).append(k)
                if places:
                    last = max(len(tokens) - window, 0)
                    found = {w: _covered(p, window, last) for w, p in places.items()}
                    for a, x in found.items():
                        for b in found.keys() & together[a]:
                            counts[a, b] += _common(x, found[b])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["a", "b", "n"])

    return run


def coherence_cv(docs: DataFrame, topics: DataFrame, id_col: str, tokens: str = "tokens", window: int = 110, eps: float = 1e-12) -> DataFrame:
    """(topic_id, c_v) of topics given as (topic_id, word): the mean cosine of each word's vector of normalised
    pointwise mutual information with the sum of all words' vectors (Roeder et al., 2015).

    Counts come from boolean sliding windows. In each document the windows that hold a word are intervals of window
    starts; lengths of these and of their intersections are added up where the document is, for the
    words of one topic only, so what is shuffled are the counts of a task."""
    ship(docs.sparkSession)
    t = topics.select("topic_id", "word").distinct()
    # A few words for each topic; ids are those of the topics themselves.
    listed = [(r["topic_id"], r["word"]) for r in t.collect()]
    last = F.greatest(F.size(tokens) - window, F.lit(0))
    n_windows = docs.where(F.size(tokens) > 0).agg(F.sum(last + 1).alias("N"))
    of_topic: dict[object, set[str]] = {}
    for topic, word in listed:
        of_topic.setdefault(topic, set()).add(word)
    together: dict[str, set[str]] = {}
    for topic, word in listed:
        together.setdefault(word, set()).update(of_topic[topic])
    counted = docs.select(tokens).mapInArrow(_window_counts(together, window), "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("nab"))
    counted = durable(counted)
    pair, single = counted, counted.where("a = b").select(F.col("a").alias("w"), F.col("nab").alias("n"))
    both = t.select("topic_id", F.col("word").alias("a")).join(t.select("topic_id", F.col("word").alias("b")), "topic_id")
    p = both.join(pair, ["a", "b"], "left").join(single.select(F.col("w").alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b", "left")
    p = p.join(F.broadcast(n_windows)).na.fill(0, ["nab", "na", "nb"])
    p_ab, p_a, p_b = (F.col(c) / F.col("N") for c in ("nab", "na", "nb"))
    npmi = F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.log((p_ab + eps) / (p_a * p_b)) / -F.log(p_ab + eps))
    v = p.select("topic_id", "a", "b", npmi.alias("x"))
    total = v.groupBy("topic_id", "b").agg(F.sum("x").alias("y"))
    cos = v.join(total, ["topic_id", "b"]).groupBy("topic_id", "a").agg((F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))))).alias("c"))
    return cos.groupBy("topic_id").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("c_v"))


def grid_scores(grid: DataFrame) -> DataFrame:
    """Adds combo_score: half the scaled inverse perplexity, half the scaled coherence; scaling is (x - min) /
    (max - min + 1e-9) over the grid, a perplexity of zero counts as missing."""
    g = grid.withColumn("perp_inv", 1 / (F.nullif("perplexity", F.lit(0.0)) + 1e-9))
    ends = g.agg(*[f(c).alias(f"_{n}_{c}") for c in ("perp_inv", "coherence_c_v") for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    g = g.join(F.broadcast(ends))
    scaled = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-9)
    return g.select(*grid.columns, scaled("perp_inv").alias("perp_inv_norm"), scaled("coherence_c_v").alias("coherence_c_v_norm"), (0.5 * scaled("perp_inv") + 0.5 * scaled("coherence_c_v")).alias("combo_score"))


def best_k(grid: DataFrame) -> DataFrame:
    """The K of lowest perplexity and of highest coherence; of equals the smallest."""
    return grid.agg(F.min(F.struct("perplexity", "K"))["K"].alias("k_by_perplexity"), F.min(F.struct((-F.col("coherence_c_v")).alias("c"), F.col("K")))["K"].alias("k_by_coherence"))


def label_table(words: DataFrame, phrases: DataFrame, sentences: DataFrame, stops=LABEL_STOPS) -> DataFrame:
    """(topic_id, lda_top10, tfidf_top10, rep_sentence) of (topic_id, rank, term), (topic_id, rank, term) and
    (topic_id, rank, text); a topic needs only one of them."""
    lda = label_terms(words, stops=stops).withColumnRenamed("terms", "lda_top10")
    tfidf = label_terms(phrases, stops=stops).withColumnRenamed("terms", "tfidf_top10")
    rep = sentences.groupBy("topic_id").agg(F.min_by("text", "rank").alias("rep_sentence"))
    return lda.join(tfidf, "topic_id", "full").join(rep, "topic_id", "full")


def topic_line(topic: Column, words: Column) -> Column:
    """A line of the topics' text file."""
    return F.format_string("Topic %02d: %s", topic, F.array_join(words, " "))


def cloud_term(phrase: Column) -> Column:
    """A phrase as a word cloud shows it: with unbreakable spaces."""
    return F.replace(phrase, F.lit("_"), F.lit("\u00a0"))

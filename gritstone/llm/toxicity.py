"""Toxicity by weak supervision.

1. Voters. Lexicon words and word-part patterns are induced from a bounded sample of labelled rows
   (the held-out part excluded), beside a small fixed lexicon and shape patterns. Each votes toxic
   where it fires and abstains elsewhere.
2. Label model. A generative model with one latent class per document explains the votes: the class share,
   each voter's firing rates by class (its accuracy), and pairwise correlations, as a forest in which a
   voter's rates also depend on the voter it says most about given the class. The marks of the labelled
   rows are one more noisy voter whose rates are estimated with the others. It is fitted by
   expectation maximisation.
3. Classifier. A linear (logistic) model is trained on the posterior labels and scores every whole
   text. Only the text is an input of a score. How strict voters must be, and the penalty on weights, are
   chosen by cross-validation inside the labelled sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped, written

#: Most labelled rows that are fitted on: all of them, or those with the smallest id hashes.
SAMPLE = 8000
#: Most induced voters.
VOTERS = 192
THRESHOLD = 0.3
#: Rows whose crc32(doc_id) mod 4 is this are never learned from.
HELD_OUT = 2

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BUCKETS = 1 << 18
#: A small general lexicon of insults and slurs of contempt.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "garbage", "filth", "imbecile", "vermin", "despicable")
_SHAPES = {
    "shape:shouting": re.compile(r"[A-Z]{4,}(?:[ ,!]+[A-Z]{3,}){2}"),
    "shape:exclaiming": re.compile(r"!{3,}"),
    "shape:you-are": re.compile(r"(?i)\byou(?:'re| are) (?:a|an|such|so)\b"),
}
_CACHE = 300_000


#: Words of more characters are met once as a rule (a clause without spaces, encoded data): what is found in them is not remembered.
_LONG = 64


def _each_gram(word: str) -> Iterator[str]:
    """What grams() holds, one after another and some repeated, so that a word may be of any length."""
    marked = f"^{word}$"
    for n in (4, 5, 6):
        yield from (marked[k : k + n] for k in range(len(marked) - n + 1))
    yield "=" + word
    yield from (">" + word[:n] for n in range(3, min(10, len(word))))
    yield from ("<" + word[-n:] for n in range(3, min(10, len(word))))


def grams(word: str) -> set[str]:
    """A word as a lexicon entry (``=word``), its beginnings and endings of 3 to 9 characters that
    something follows or precedes (``>begin``, ``<end``), and its parts of 4 to 6, ends marked."""
    return set(_each_gram(word))


def _distinct_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


class Votes:
    """Which of the given voters fire on a text. Words are looked up once each and remembered."""

    def __init__(self, names: list[str]):
        self.names = names
        self.at = {n: k for k, n in enumerate(names)}
        self.shapes = [(self.at[n], p) for n, p in _SHAPES.items() if n in self.at]
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> tuple[set[int], int]:
        """(voters that fire, distinct words that made one fire)"""
        fired, hits = set(), 0
        if not text:
            return fired, hits
        known, at = self.known, self.at
        for word in _distinct_words(text):
            found = known.get(word) if len(word) <= _LONG else {at[g] for g in _each_gram(word) if g in at}
            if found is None:
                if len(known) >= _CACHE:
                    known.clear()
                found = known[word] = tuple(at[g] for g in grams(word) if g in at)
            if found:
                fired.update(found)
                hits += 1
        fired.update(k for k, p in self.shapes if p.search(text))
        return fired, hits


# ---------------------------------------------------------------- label model and classifier


class LabelModel:
    """One latent class, and a forest of pairwise dependencies among the voters, fitted by EM.

    After ``fit``: ``share`` of the class; ``on`` and ``off``, each voter's firing rate in and out of it;
    ``accuracy``, how often a voter that fires is right; ``parent``, the voter that a voter's rates
    also depend on (-1: none); ``mark_on`` and ``mark_off``, the rates of the marks.
    """

    #: Rows of prior belief in marks, and what they say: the estimates need not start from nothing.
    PRIOR_ROWS, PRIOR_ON, PRIOR_OFF = 20.0, 0.9, 0.02

    def __init__(self, rounds: int = 40, least_information: float = 0.005):
        self.rounds, self.least_information = rounds, least_information

    def fit(self, votes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """votes: rows x voters, 0/1; marks: 0/1 per row. Returns each row's posterior of the class."""
        v = np.asarray(votes, np.float64)
        fired, marks = v > 0, np.asarray(marks, np.float64)
        self.parent = np.full(v.shape[1], -1)
        post = np.clip(marks, 0.05, 0.95)
        for step in range(self.rounds):
            if step in (3, 8, 13):  # anew as the posterior settles
                self.parent = self._forest(v, post)
            likelihood = self._estimate(v, fired, post, marks)
            new = 1 / (1 + np.exp(-np.clip(likelihood, -30, 30)))
            moved = np.abs(new - post).max() if len(post) else 0.0
            post = new
            if moved < 1e-4 and step > 13:
                break
        self.accuracy = self.share * self.on / (self.share * self.on + (1 - self.share) * self.off)
        return post

    def _estimate(self, v: np.ndarray, fired: np.ndarray, post: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Rates from the posterior, and from these each row's log odds of the class."""
        n, rates = len(v), []
        has_parent = self.parent >= 0
        above = np.where(has_parent, fired[:, self.parent], False)
        for weight in (post, 1 - post):
            rate = (weight @ v + 0.5) / (weight.sum() + 1)
            # With a parent: the rate where it fires and where it does not, drawn to the plain one by two rows.
            both, alone = weight @ (v * above), weight @ above
            with_it, without = (both + 2 * rate) / (alone + 2), (weight @ v - both + 2 * rate) / (weight.sum() - alone + 2)
            rates.append((rate, np.clip(with_it, 1e-6, 1 - 1e-6), np.clip(np.where(has_parent, without, rate), 1e-6, 1 - 1e-6)))
        (self.on, *on), (self.off, *off) = rates
        self.share = float(np.clip((post.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4))
        k = self.PRIOR_ROWS
        self.mark_on = float((post @ marks + k * self.PRIOR_ON) / (post.sum() + k))
        self.mark_off = float(((1 - post) @ marks + k * self.PRIOR_OFF) / ((1 - post).sum() + k))
        logit = np.full(n, np.log(self.share / (1 - self.share)))
        logit += np.where(marks > 0, np.log(self.mark_on / self.mark_off), np.log((1 - self.mark_on) / (1 - self.mark_off)))
        p, q = np.where(above, on[0], on[1]), np.where(above, off[0], off[1])
        return logit + np.where(fired, np.log(p / q), np.log((1 - p) / (1 - q))).sum(axis=1)

    def _forest(self, v: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Each voter's parent in the forest of greatest information between voters given the class."""
        m, information = v.shape[1], np.zeros((v.shape[1], v.shape[1]))
        for weight in (post, 1 - post):
            total = weight.sum() + 1e-9
            one = weight @ v / total
            both = (v * weight[:, None]).T @ v / total
            for x, y, joint in ((one[:, None], one[None, :], both), (one[:, None], 1 - one[None, :], one[:, None] - both), (1 - one[:, None], one[None, :], one[None, :] - both), (1 - one[:, None], 1 - one[None, :], 1 - one[:, None] - one[None, :] + both)):
                information += total / len(v) * joint.clip(1e-12) * np.log(joint.clip(1e-12) / (x * y).clip(1e-12))
        np.fill_diagonal(information, 0)
        parent, best, source, done = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.zeros(m, bool)
        for _ in range(m):
            now = int(np.argmax(np.where(done, -np.inf, best)))
            if best[now] >= self.least_information:
                parent[now] = source[now]
            done[now] = True
            nearer = ~done & (information[now] > best)
            best[nearer], source[nearer] = information[now][nearer], now
        return parent


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _log_loss(marks: np.ndarray, z: np.ndarray, model: LabelModel) -> float:
    """Of marks, which are as noisy as the label model says, under the classes' log odds ``z``."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    q = np.clip(p * model.mark_on + (1 - p) * model.mark_off, 1e-6, 1 - 1e-6)
    return float(-np.mean(marks * np.log(q) + (1 - marks) * np.log(1 - q)))


#: What cross-validation chooses from: toxic to clean rows where a voter fires, and the penalty on weights.
STRICTNESS, RIDGES, FOLDS = (1.0, 2.0, 4.0), (1e-3, 1e-2), 3


def _features(votes: np.ndarray) -> np.ndarray:
    """What the linear model sees: each vote, and the logarithm of their number."""
    return np.c_[votes, np.log1p(votes.sum(axis=1, dtype=np.float64))]


def choose(matrix: np.ndarray, marks: np.ndarray, columns: dict[float, list[int]]) -> tuple[float, float]:
    """(strictness, ridge) with the smallest log loss on the folds left out; ``columns`` gives each strictness's voters."""
    fold = np.arange(len(marks)) % FOLDS
    loss: dict[tuple[float, float], float] = {}
    for strict, at in columns.items():
        x = _features(matrix[:, at])
        total = dict.fromkeys(RIDGES, 0.0)
        for k in range(FOLDS):
            learn = fold != k
            model = LabelModel(rounds=16)
            posterior = model.fit(matrix[learn][:, at], marks[learn])
            for ridge in RIDGES:
                w = fit_linear(x[learn], posterior, ridge, rounds=12)
                total[ridge] += _log_loss(marks[~learn], np.c_[x[~learn], np.ones((~learn).sum())] @ w, model)
        loss.update({(strict, ridge): total[ridge] for ridge in RIDGES})
    return min(loss, key=lambda c: (loss[c], -c[0], -c[1]))


class ToxicityModel:
    """A fitted classifier: voters and weights. Small, and independent of the corpus size."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scorer(self):
        votes, w = Votes(self.names), self.weights

        def score(text: str | None) -> float:
            fired, _ = votes.of(text)
            z = w[-1] + w[len(self.names)] * np.log1p(len(fired)) + sum(w[k] for k in fired)
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


# ---------------------------------------------------------------- Spark


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled rows outside the held-out part."""
    marks = labels.select(column_or_null(labels, "doc_id", "bigint").alias("doc_id"), column_or_null(labels, "toxic", "int").alias("toxic"))
    marks = marks.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most `bound` rows of two integers: the broadcast has a fixed bound.
    texts = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _BUCKETS), np.int64)
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = [np.zeros(0, np.int32)]
            for word in _distinct_words(text):
                if len(word) > _LONG:
                    seen.append(np.unique(np.fromiter((zlib.crc32(g.encode()) % _BUCKETS for g in _each_gram(word)), np.int32)))
                    continue
                at = known.get(word)
                if at is None:
                    if len(known) >= _CACHE // 3:
                        known.clear()
                    at = known[word] = np.array([zlib.crc32(g.encode()) % _BUCKETS for g in grams(word)], np.int32)
                seen.append(at)
            counts[int(toxic), np.unique(np.concatenate(seen))] += 1
    at = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], names=["bucket", "pos", "neg"])


def _count_grams(buckets: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for word in _distinct_words(text):
                    if len(word) > _LONG:
                        found.update(g for g in _each_gram(word) if zlib.crc32(g.encode()) % _BUCKETS in buckets)
                        continue
                    hit = known.get(word)
                    if hit is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        hit = known[word] = tuple(g for g in grams(word) if zlib.crc32(g.encode()) % _BUCKETS in buckets)
                    found.update(hit)
                counts[int(toxic)].update(found)
        keys = list(counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["gram", "pos", "neg"]
        )

    return run


def _worth(n_pos: int, n_neg: int):
    """How much a voter says: smoothed log odds of its firing rates, weighted by its toxic rate."""
    on, off = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
    return on * F.log(on / off)


def _distinct_voters(ranked: list[tuple[str, int]], most: int) -> list[str]:
    """The best voters that say something new: a part of a chosen voter, or one that holds it, is left
    out where it fires about as often, as both then fire on the same words."""
    chosen: list[tuple[str, str, int]] = []
    for gram, pos in ranked:
        core = gram.strip("^$=<>")
        if not any((core in c or c in core) and abs(n - pos) <= 0.05 * max(n, pos) for _, c, n in chosen):
            chosen.append((gram, core, pos))
            if len(chosen) >= most:
                break
    return [gram for gram, _, _ in chosen]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows. Without rows of both classes the fixed lexicon decides."""
    rows = written(_sample(docs, labels, sample))
    totals = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(True, 0), totals.get(False, 0)
    fixed = ["=" + w for w in LEXICON] + list(_SHAPES)
    if not n_pos or not n_neg:
        return ToxicityModel(fixed, np.r_[np.full(len(fixed), 1.5), 0.0, -3.0])
    texts = rows.select("text", "toxic")
    counted = mapped(texts, _count_buckets, "bucket bigint, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(2, n_pos // 400)
    best = counted.where(F.col("pos") >= least).orderBy(_worth(n_pos, n_neg).desc(), "bucket").limit(voters * 16)
    buckets = frozenset(r["bucket"] for r in best.select("bucket").collect())
    exact = mapped(texts, _count_grams(buckets), "gram string, pos bigint, neg bigint").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    exact = exact.where((F.col("pos") >= least) & (F.col("pos") >= min(STRICTNESS) * F.col("neg")))
    ranked = [(r["gram"], r["pos"], r["neg"]) for r in exact.orderBy(_worth(n_pos, n_neg).desc(), F.length("gram").desc(), "gram").limit(voters * 32).collect()]
    induced = {strict: _distinct_voters([(g, p) for g, p, n in ranked if p >= strict * n], voters) for strict in STRICTNESS}
    names = list(dict.fromkeys([*(g for some in induced.values() for g in some), *fixed]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(names)
        for batch in batches:
            fired = [votes.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(x) for x, _ in fired], pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "fired", "toxic"])

    # At most `sample` rows of voter numbers, in the order of their ids' hashes: folds do not hang on how rows were dealt.
    data = mapped(rows.select("doc_id", "text", "toxic"), features, "doc_id bigint, fired array<int>, toxic int").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    matrix = np.zeros((len(data), len(names)), np.float32)
    for k, r in enumerate(data):
        matrix[k, r["fired"]] = 1
    marks = np.array([r["toxic"] for r in data], np.float64)
    at = {n: k for k, n in enumerate(names)}
    columns = {strict: [at[n] for n in dict.fromkeys(some + fixed)] for strict, some in induced.items()}
    strict, ridge = choose(matrix, marks, columns)
    chosen = columns[strict]
    posterior = LabelModel().fit(matrix[:, chosen], marks)
    return ToxicityModel([names[k] for k in chosen], fit_linear(_features(matrix[:, chosen]), posterior, ridge))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held_out marks rows with crc32(doc_id as text) mod 4 = 2 (false for a null id). Null and empty
    texts score what a text without any vote does. Whole texts are scored, words of any length too. Repeated rows
    stay; an empty table gives no rows; without labels of both classes a fixed lexicon decides. Only doc_id
    and text are read, whatever other columns are called.
    """
    model = fit_toxicity(docs, labels, sample)
    source = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return mapped(source, run, "doc_id bigint, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold; columns unchanged, whatever their names. Null and
    empty texts are scored as score_toxicity does, repeated rows alike; an empty table stays empty."""
    model = fit_toxicity(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)

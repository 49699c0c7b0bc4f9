"""Best-fit packing of documents into sequences of fixed length, by patterns.

Only the histogram of piece lengths decides how sequences are filled, so the plan is made once, on
``capacity`` numbers, whatever the corpus size:

1. patterns of up to three lengths that fill a sequence exactly are enumerated;
2. non-negative least squares fits repeat counts to the histogram;
3. the counts are rounded down and never take more pieces than there are;
4. what is left is packed best fit, longest first, on the histogram itself.

The plan is a table of intervals: pieces number i to j of a length stand at offset o of sequences s to
s + (j - i). Pieces get their number within their length by counts per (length, bucket), and look
their place up; no document is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, mapped, written
from .tokenise import encoder, vocabulary

CAPACITY = 1024
#: Pieces of one length that are numbered together: a length with more has several buckets, up to so many.
BUCKET_ROWS, BUCKETS = 1000, 65_536


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole, or whole sequences after a first piece of the rest."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


# ---------------------------------------------------------------- the plan


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths whose sum is the capacity, as rows (0: nothing)."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    a = lengths[lengths < capacity]
    two = a[there[capacity - a] & (a >= capacity - a)]
    rows.append(np.stack([two, capacity - two, np.zeros_like(two)], 1))
    for x in a[a * 3 >= capacity]:
        y = a[(a <= x) & (a * 2 >= capacity - x) & (a < capacity - x)]
        z = capacity - x - y
        good = there[z] & (z <= y)
        rows.append(np.stack([np.full(good.sum(), x), y[good], z[good]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the histogram by accelerated projected gradients. A missing
    long piece weighs more than a short one, which fits anywhere."""
    if not len(patterns):
        return np.zeros(0)
    weight = np.sqrt(np.arange(len(histogram)) / (len(histogram) - 1.0)) + 0.05
    weight[0] = 0
    goal = histogram * weight
    used = patterns > 0
    # Step size from the norm bound: columns have at most three entries, rows as many as patterns share them.
    degree = np.bincount(patterns[used], minlength=len(histogram)).astype(float)
    step = 1.0 / max(1e-9, 3 * (degree * weight**2).max())
    x = np.zeros(len(patterns))
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        made = np.zeros(len(histogram))
        for k in range(3):
            made += np.bincount(patterns[:, k], y, minlength=len(histogram))
        slope = weight * (weight * made - goal)
        slope[0] = 0
        new = np.maximum(0, y - step * (slope[patterns[:, 0]] + slope[patterns[:, 1]] + slope[patterns[:, 2]]))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of a histogram: (lengths in a sequence, how many such sequences)."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if n:
            of = bins.setdefault(room, {})
            of[content] = of.get(content, 0) + n

    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            room = min((r for r in bins if r >= length and bins[r]), default=None)
            content, n = bins[room].popitem() if room is not None else ((), 0)
            if room is None:
                # New sequences, each with as many of this length as it holds.
                each = capacity // length
                n, over = divmod(left, each)
                put(capacity - each * length, (length,) * each, n)
                put(capacity - over * length, (length,) * over, 1 if over else 0)
                left = 0
                continue
            each = room // length
            full, over = divmod(left, each)
            if full >= n:
                put(room - each * length, content + (length,) * each, n)
                left -= n * each
            else:
                put(room - each * length, content + (length,) * each, full)
                put(room - over * length, content + (length,) * over, 1 if over else 0)
                put(room, content, n - full - (1 if over else 0))
                left = 0
    return [(content, n) for of in bins.values() for content, n in of.items() if n]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) that hold every piece exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    counts = np.floor(fit_counts(patterns, left.astype(float)) + 1e-6).astype(np.int64)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] <= 0:
            break
        row = tuple(int(v) for v in patterns[k] if v)
        need = {v: row.count(v) for v in row}
        n = min(int(counts[k]), *(int(left[v]) // m for v, m in need.items()))
        if n > 0:
            out.append((row, n))
            for v, m in need.items():
                left[v] -= n * m
    return out + best_fit(left, capacity)


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted intervals: length, first number, first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, n in planned:
        at = 0
        for length in content:
            rows.append((length, taken.get(length, 0), sequence, at))
            taken[length] = taken.get(length, 0) + n
            at += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "number": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


# ---------------------------------------------------------------- Spark


def cut_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and, if asked for, each piece's ids."""
    path = path or vocabulary("byte_bpe_50k.json")
    source = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        kind, end = f"<u{tokenizer.width}", end_id.to_bytes(tokenizer.width, "little")
        for batch in batches:
            rows, bodies = [], []
            for key, raw in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                ids = np.frombuffer(raw + end, kind).astype("<u4").tobytes()
                at = 0
                for piece, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    body = ids[4 * at : 4 * (at + n)]
                    rows.append((key, piece, at, n, zlib.crc32(body)))
                    bodies.append(body)
                    at += n
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in bodies], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return mapped(source, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids, holds=path)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (ids on request), sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows, and rows that share an id or lack
    one, are documents of their own. A text of any length is encoded whole and cut only after that. An
    empty table has no pieces. Other columns, whatever their names, are not read.
    """
    pieces = written(cut_documents(docs, path, end_id, capacity, with_ids))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["n"]
    table = intervals(plan(histogram, capacity))
    # A number of buckets for each length, by its count.
    buckets = F.array(*[F.lit(int(max(1, min(BUCKETS, -(-n // BUCKET_ROWS))))) for n in histogram.tolist()])
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))).cast("int"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = bucketed.withColumn("number", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"])
    numbered = numbered.select(*pieces.columns, (F.col("first") + F.col("number")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {int(v): k for v, k in zip(*np.unique(table["length"], return_index=True), strict=True)}
        edge = {int(v): len(table["length"]) - k for v, k in zip(*np.unique(table["length"][::-1], return_index=True), strict=True)}
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length).tolist():
                rows = length == v
                at = low[v] + np.searchsorted(table["number"][low[v] : edge[v]], number[rows], "right") - 1
                sequence[rows] = table["sequence"][at] + number[rows] - table["number"][at]
                offset[rows] = table["offset"][at]
            arrays = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return mapped(numbered, place, fields + ", sequence_id bigint, offset bigint")

"""Token-id output: encode whole texts, store them in directly addressable files in id order, read back.

The store is a table of files' bytes (see ``dac``) in the shared folder, written by Spark's own
committer, so that any file system Spark can reach will do and a lost executor costs only its tasks.
The table is not compressed: a file's bytes lie in the Parquet file as they are, and a token of them is
read without decoding anything else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped, written
from .dac import Reader, encode
from .tokenise import encoder, vocabulary

#: Ids after which a file is closed at the next document's end.
FILE_IDS = 1 << 20
#: Bytes of text of a range (a task), and the most ranges, whose totals the driver adds up.
RANGE_BYTES, RANGES = 16 << 20, 50_000
_NULL = -(1 << 63)


def _ranges(source: DataFrame, range_bytes: int) -> int:
    size = source.agg(F.coalesce(F.sum(32 + F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    return max(1, min(RANGES, -(-int(size) // range_bytes)))


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 1, range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text, ``end_id`` after each, and store the ids in ascending doc_id order.

    Returns the store, read back: (range, before, n_ids, data), ``before`` the ids of the range's
    earlier files. A null text is empty; a null id comes first; rows with equal ids are ordered by a
    hash of their texts, and ranges are cut by id and hash, so an id that many rows share (or
    lack) is in many ranges; only rows equal in both stay together, streamed. A file
    holds whole documents, however long. An empty table gives an empty store; other columns are not read.
    """
    path = path or vocabulary("word_bpe_49k.json")
    source = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    ranges = _ranges(source, range_bytes)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        kind, end = f"<u{tokenizer.width}", end_id.to_bytes(tokenizer.width, "little")
        part, before, size = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        bodies: list[bytes] = []

        def close():
            nonlocal keys, bodies, size, before
            lengths = np.fromiter(map(len, bodies), np.int64, len(bodies)) // tokenizer.width
            data = encode(np.array(keys, np.int64), lengths, np.frombuffer(b"".join(bodies), kind))
            row = pa.RecordBatch.from_pydict({"range": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})
            before, size, keys, bodies = before + size, 0, [], []
            return row

        for batch in batches:
            for key, ids in zip(batch.column(0).fill_null(_NULL).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                keys.append(key)
                bodies.append(ids + end)
                size += len(ids) // tokenizer.width + 1
                if size >= file_ids:
                    yield close()
        if keys:
            yield close()

    # Ranges are cut on the texts, before the encoder: Spark samples what it cuts. Nulls sort first.
    keyed = source.withColumn("hash", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return written(mapped(dealt, files, "range int, before bigint, n_ids bigint, data binary", holds=path), "uncompressed")


def read_tokens(store: DataFrame) -> DataFrame:
    """Per document of the store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    placed = _placed(store).select("first", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(data.as_buffer())
                ids, at = memoryview(reader.tokens(0, len(reader)).astype("<u4")).cast("B"), (4 * reader.starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                keys = pa.array(reader.keys, pa.int64(), mask=reader.keys == _NULL)
                yield pa.RecordBatch.from_arrays([keys, pa.array(reader.starts[:-1] + first), pa.array(reader.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _placed(store: DataFrame) -> DataFrame:
    """The store with ``first``, the ids of all files before each."""
    totals = store.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect()  # RANGES rows at most
    starts, at = [], 0
    for row in totals:
        starts.append((row["range"], at))
        at += row["n"]
    offsets = store.sparkSession.createDataFrame(starts, "range int, offset bigint")
    return store.join(F.broadcast(offsets), "range").withColumn("first", F.col("offset") + F.col("before"))


def tokens_at(store: DataFrame, positions: list[int]) -> DataFrame:
    """(position, token): single tokens of the whole corpus, by their place in it. Only the files that hold a
    position are opened, and in them only the chunks of the tokens asked for; a position past the end gives no row."""
    wanted = np.array(sorted(set(positions)), np.int64)
    placed = _placed(store)
    spans = F.array(*[F.lit(int(p)) for p in wanted]) if len(wanted) else F.expr("array()").cast("array<bigint>")
    held = placed.withColumn("at", F.filter(spans, lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n_ids"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                reader = Reader(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([reader.token(p - first) for p in at], pa.int64())], names=["position", "token"])

    return mapped(held.where(F.size("at") > 0).select("first", "at", "data"), run, "position bigint, token bigint")


def token_report(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the store and digest what is read back from it. An empty table gives an empty result."""
    return read_tokens(write_tokens(docs, path, end_id))

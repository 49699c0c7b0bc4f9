"""Exact removal of repeated byte strings by suffix arrays over shards.

Every byte that lies in a ``size``-byte string which also starts elsewhere is removed; strings are
judged on the input. The whole corpus never stands in one array. Instead:

1. Equal texts become one, with their number. All rows of a text have the same result.
2. Anchors. In each window of consecutive ``GRAM``-byte grams the one with the smallest hash (the
   leftmost of equals) is an anchor; a window spans ``size`` bytes, so every string of that length
   holds an anchor, at the same place wherever the string stands. An anchor that occurs once can
   belong to no repeat, and its surroundings drop out here.
3. Segments. The surroundings of an anchor hold all ``size``-byte strings around it. Equal segments
   of an anchor are one, with their number; a segment that occurs twice is a repeat as it stands.
4. Shards. Anchors with different segments are sorted in suffix arrays of a few MB, whole
   anchors each; permuted common prefixes of neighbours at the same place of the same anchor
   tell which strings repeat. Anchors with very many different segments are first split by the
   bytes that a range of places has in common.
5. Repeats go back to the texts as intervals.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import uuid
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped, shared_dir, shuffle_width, written
from .suffix_array import common_prefixes, suffix_array

SIZE = 200
GRAM = 32
#: Bytes of a shard, after which it is closed at the next anchor's end: its arrays stay in a core's cache.
SHARD = 1 << 19
#: Bytes whose anchors are found at once; places in them must fit 24 bits.
LOT = 8 << 20
#: Different segments of an anchor from which on it is split by common bytes, and into how many ranges.
HOT_SEGMENTS, RANGES = 4096, 8
_SIGN = 1 << 63


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` (32) bytes from each position on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    w = data.astype(np.uint64)
    for width in (1, 2, 4):
        w = w[:-width] | (w[width:] << np.uint64(8 * width))
    for width, odd in ((8, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F)):
        w = w * np.uint64(odd)
        w ^= w >> np.uint64(29)
        w = w[:-width] * np.uint64(0xD6E8FEB86659FD93) + w[width:]
    w ^= w >> np.uint64(32)
    w *= np.uint64(0xD6E8FEB86659FD93)
    w ^= w >> np.uint64(31)
    return w


def anchors(data: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie end to end; text k begins at starts[k],
    and starts closes with the total length."""
    hashes = gram_hashes(data)
    width = size - GRAM + 1
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.uint64((1 << 24) - 1)
    keys = (hashes & ~place) | (np.arange(len(hashes), dtype=np.uint64) & place)
    padded = np.full(-(-len(keys) // width) * width, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    # Only windows inside one text count.
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    least = least[np.arange(n) + size <= ends]
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = (least & place).astype(np.int64)
    found = low[np.r_[True, low[1:] != low[:-1]]]
    return found, hashes[found]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# ---------------------------------------------------------------- passes over texts


def _digests(size: int):
    """(doc_id, text) to (doc_id, h1, h2, n_bytes, short): short is the text itself where it is too
    short to repeat, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            digests = [xxhash.xxh3_128_intdigest(t) for t in texts]
            h1, h2 = [(d >> 64) - _SIGN for d in digests], [(d & (2**64 - 1)) - _SIGN for d in digests]
            arrays = [batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t if len(t) < size else None for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h1", "h2", "n_bytes", "short"])

    return run


def _first_texts(size: int):
    """(text) to (h1, h2, text), each text that is long enough once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep, digests = [], []
            for text in batch.column(0):
                t = text.as_py() or b""
                d = xxhash.xxh3_128_intdigest(t) if len(t) >= size else None
                keep.append(d is not None and d not in seen)
                if keep[-1]:
                    seen.add(d)
                    digests.append(d)
            texts = batch.column(0).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([(d >> 64) - _SIGN for d in digests], pa.int64()), pa.array([(d & (2**64 - 1)) - _SIGN for d in digests], pa.int64()), texts], names=["h1", "h2", "text"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2): one for each digest, with a key of 64 bits that no other has."""
    last = None
    for batch in batches:
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep, keys = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        for k, now in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
            if now != last:
                keep[k] = True
                clash = last is not None and last[0] == now[0]
                keys[k] = xxhash.xxh3_64_intdigest(f"{now[0]}:{now[1]}") - _SIGN if clash else now[0]
                last = now
        chosen = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), *chosen.columns], names=["key", *batch.schema.names])


def _find_anchors(size: int):
    def row(joined: bytes, starts: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        doc = np.searchsorted(starts, at, "right") - 1
        low, high = np.maximum(starts[doc], at - (size - GRAM)), np.minimum(starts[doc + 1], at + size)
        digest = xxhash.xxh3_64_intdigest
        segments = np.fromiter((digest(joined[a:b], k) for a, b, k in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)), np.uint64, len(at))
        return pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array(_signed(segments)), pa.array(keys[doc]), pa.array((at - starts[doc]).astype(np.int32))], names=["anchor", "segment", "key", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lot in _lots(whole):
                texts, keys = lot.column(1).to_pylist(), lot.column(0).to_numpy()
                starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                joined = b"".join(texts)
                data = np.frombuffer(joined, np.uint8)
                if len(data) <= LOT + size:
                    at, hashes = anchors(data, starts, size)
                else:  # one long text, in parts that overlap by all but one place of a string
                    parts = [(k, anchors(data[k : k + LOT + size - 1], np.array([0, len(data[k : k + LOT + size - 1])]), size)) for k in range(0, len(data), LOT)]
                    at = np.concatenate([x + k for k, (x, _) in parts])
                    at, first = np.unique(at, return_index=True)
                    hashes = np.concatenate([h for _, (_, h) in parts])[first]
                if len(at):
                    yield row(joined, starts, keys, at, hashes)

    return run


def _lots(batch: pa.RecordBatch, most: int = LOT) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column 1) stay below the bound; a longer text is one by itself."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)])
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _cut_segments(size: int):
    """(text, places) to the segments' bytes: (anchor, segment, left, many, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                for p in places.as_py():
                    low = max(0, p["pos"] - (size - GRAM))
                    rows.append((p["anchor"], p["segment"], p["pos"] - low, p["hot"], t[low : p["pos"] + size]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "segment", "left", "hot", "data"])

    return run


def _split_hot(size: int, ranges: int = RANGES):
    """Segments of a hot anchor, once for each range of string starts, grouped by the bytes that all
    strings starting in that range have in common; other segments as they are. Adds ``grp``."""
    edges = [(size - GRAM + 1) * k // ranges for k in range(ranges + 1)]

    def parts(anchor: int, left: int, data: bytes):
        """A string starts ``back`` bytes before the anchor; the text's ends may bound the range."""
        least = max(0, left + size - len(data))
        for k in range(ranges):
            near, far = max(edges[k], least), min(edges[k + 1] - 1, left)
            if near <= far:
                common = data[left - edges[k] : left - edges[k + 1] + 1 + size]
                group = xxhash.xxh3_64_intdigest(common, (anchor + k) & (2**64 - 1)) - _SIGN
                yield group, far, data[left - far : left - near + size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, segment, left, hot, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot:
                    rows.extend((group, anchor, segment, new_left, part) for group, new_left, part in parts(anchor, left, data))
                else:
                    rows.append((anchor, anchor, segment, left, data))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "anchor", "segment", "left", "data"])

    return run


# ---------------------------------------------------------------- shards


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of intervals as sorted disjoint ones; those that touch become one."""
    a, b = [], []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if b and s <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(s)
            b.append(e)
    return a, b


def repeats(groups: np.ndarray, lefts: np.ndarray, segments: list[bytes], size: int = SIZE) -> list[tuple[list[int], list[int]]]:
    """For each segment, the intervals covered by ``size``-byte strings that another segment of its
    group has at the same distance from the anchor."""
    lengths = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8 text
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    room = np.repeat(starts + lengths, lengths + 1) - np.arange(len(data))
    order = suffix_array(data, size).astype(np.int64)
    order = order[room[order] >= size]
    # Neighbours count only at the same place of the same anchor; a stable sort keeps suffix order.
    place = (order - starts[owner[order]] - lefts[owner[order]] + (1 << 12)).astype(np.uint16)
    order = order[np.argsort(place, kind="stable")]
    number = np.unique(groups, return_inverse=True)[1]
    for shift in (0, 16):
        digit = ((number[owner[order]] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    at = order - starts[owner[order]] - lefts[owner[order]]
    pair = (number[owner[order[1:]]] == number[owner[order[:-1]]]) & (at[1:] == at[:-1])
    here, other = order[1:][pair], order[:-1][pair]
    back = np.argsort(here, kind="stable")
    here, other = here[back], other[back]
    most = np.minimum(room[here], room[other])
    long = common_prefixes(data, here, other, most) >= size
    hit = np.zeros(len(data), bool)
    hit[here[long]] = True
    hit[other[long]] = True
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in segments]
    p = np.flatnonzero(hit)
    if len(p):
        own = owner[p]
        # Runs of string starts that overlap or touch, within a segment.
        new = np.r_[True, (own[1:] != own[:-1]) | (p[1:] > p[:-1] + size)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(p) - 1]
        for k, a, b in zip(own[first].tolist(), (p[first] - starts[own[first]]).tolist(), (p[last] - starts[own[first]] + size).tolist(), strict=True):
            out[k][0].append(a)
            out[k][1].append(b)
    return out


def comparable(rows: list[tuple], size: int) -> list[tuple]:
    """Rows (grp, anchor, segment, left, data) of whole groups, without what can match no other row of
    its group. A string around the anchor either starts by half its room before it, and holds the
    bytes from there to the gram's end, or starts later, and holds the bytes after the gram up to there;
    a row goes where it shares neither with another, and loses the half it does not share."""
    half = (size - GRAM) // 2
    before: dict[tuple, int] = {}
    after: dict[tuple, int] = {}
    digest = xxhash.xxh3_64_intdigest
    keys = []
    for grp, _, _, left, data in rows:
        a = (grp, digest(data[left - half : left + GRAM])) if left >= half else None
        end = left + size - half
        b = (grp, digest(data[left:end], 1)) if len(data) >= end else None
        keys.append((a, b))
        if a:
            before[a] = before.get(a, 0) + 1
        if b:
            after[b] = after.get(b, 0) + 1
    out = []
    for row, (a, b) in zip(rows, keys, strict=True):
        grp, anchor, segment, left, data = row
        early, late = a is not None and before[a] > 1, b is not None and after[b] > 1
        if early and late:
            out.append(row)
        elif early:
            out.append((grp, anchor, segment, left, data[: left + size - half]))
        elif late:
            cut = max(0, left - half)
            out.append((grp, anchor, segment, left - cut, data[cut:]))
    return out


def _sort_shards(size: int, shard: int = SHARD):
    """Segments sorted by grp, whole groups in a partition: (anchor, segment, start, end) of each
    repeated interval, relative to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, now = 0, None

        def close():
            rows = comparable(held, size)
            found = repeats(np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], size) if rows else []
            rows = [(r[1], r[2], a - r[3], b - r[3]) for r, (s, e) in zip(rows, found, strict=True) for a, b in zip(s, e, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "segment", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= shard and row[0] != now:
                    yield close()
                    held, total = [], 0
                now = row[0]
                held.append(row)
                total += len(row[4])
        if held:
            yield close()

    return run


def _remove(size: int):
    """(h1, h2, text, intervals) to (h1, h2, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, bodies = [], [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                t, ivs = text.as_py(), found.as_py() or []
                a, b = merged([max(0, x["a"]) for x in ivs], [min(len(t), x["b"]) for x in ivs])
                bodies.append(b"".join(t[s:e] for s, e in zip([0, *b], [*a, len(t)], strict=True)))
                removed.append(len(t) - len(bodies[-1]))
                spans.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(bodies, pa.binary())], names=["h1", "h2", "n_removed", "n_spans", "kept"])

    return run


def _bucketed(texts: DataFrame, width: int) -> DataFrame:
    """Write the texts bucketed by key in the shared folder: the two later joins on key then move only
    their small sides."""
    spark = texts.sparkSession
    name = f"gritstone_texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    texts.write.format("parquet").bucketBy(width, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)

    def forget():
        # The files go with the application; a catalog that outlives it must not keep the name.
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(forget)
    return spark.table(name)


def repeated_strings(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, on request).

    Texts are UTF-8 bytes, null ones empty; matches never cross documents. Texts shorter than ``size``
    lose nothing. Repeated rows are occurrences of their own, so each loses all its bytes when
    long enough. Very long texts are judged whole, their anchors found in overlapping parts. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    if size <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    width = shuffle_width(docs.sparkSession)
    source = docs.select(column_or_null(docs, id_col, "bigint").alias("doc_id"), column_or_null(docs, text_col, "binary").alias("text"))
    rows = written(mapped(source, _digests(size), "doc_id bigint, h1 bigint, h2 bigint, n_bytes bigint, short binary"))

    firsts = mapped(source.select("text"), _first_texts(size), "h1 bigint, h2 bigint, text binary")
    firsts = firsts.repartition(width, "h1").sortWithinPartitions("h1", "h2")
    texts = _bucketed(mapped(firsts, _once, "key bigint, h1 bigint, h2 bigint, text binary"), width)

    places = written(mapped(texts.select("key", "text"), _find_anchors(size), "anchor bigint, segment bigint, key bigint, pos int"))
    counts = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high")).where("n > 1")
    # Written, so that both sides of the join are plain exchanges and AQE may split a hot anchor's partition.
    counts = written(counts.select("anchor", (F.col("low") == F.col("high")).alias("alike")))
    shared = written(places.join(counts, "anchor"))

    # One occurrence stands for all that have the same segment.
    kinds = written(shared.where("not alike").groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at")))
    # Few rows, and written: the join has no aggregate between an exchange and itself.
    hot = written(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot_segments).select("anchor", F.lit(True).alias("hot")))
    wanted = kinds.join(hot, "anchor", "left").groupBy(F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct("anchor", "segment", F.col("at.pos").alias("pos"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places")
    )
    cut = mapped(texts.select("key", "text").join(wanted, "key").select("text", "places"), _cut_segments(size), "anchor bigint, segment bigint, left int, hot boolean, data binary")
    split = mapped(cut, _split_hot(size), "grp bigint, anchor bigint, segment bigint, left int, data binary")
    in_order = split.repartition(width, "grp").sortWithinPartitions("grp")
    found = mapped(in_order, _sort_shards(size), "anchor bigint, segment bigint, a int, b int")
    twice = kinds.where("n > 1").select("anchor", "segment", F.lit(-(size - GRAM)).alias("a"), F.lit(size).alias("b"))
    known = written(found.unionByName(twice))

    whole = shared.where("alike").select("key", (F.col("pos") - (size - GRAM)).alias("a"), (F.col("pos") + size).alias("b"))
    part = shared.where("not alike").join(known, ["anchor", "segment"]).select("key", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"))
    copied = rows.where(F.col("n_bytes") >= size).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    copied = texts.select("key", "h1", "h2").join(copied, ["h1", "h2"]).select("key", F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b"))
    cover = whole.unionByName(part).unionByName(copied).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    judged = texts.join(cover, "key", "left").select("h1", "h2", "text", "found")
    result = mapped(judged, _remove(size), "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept binary")
    result = result.withColumn("kept_sha256", F.sha2("kept", 256))
    if not with_text:
        result = result.drop("kept")
    result = rows.join(written(result), ["h1", "h2"], "left")
    zero = F.lit(0).cast("bigint")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.sha2("short", 256)).alias("kept_sha256")]
    return result.select(*columns, *([F.coalesce("kept", "short").alias("kept")] if with_text else []))

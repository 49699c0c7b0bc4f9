"""Benchmark decontamination by a Wu-Manber search over words.

The patterns are windows of consecutive benchmark words. A shift table on hashed pairs of words tells
how far the search may move when the pair under the cursor ends no pattern; where it may not move,
a bucket keyed by a hash of the pattern's last words gives the test strings, and those are compared
directly. Windows shorter than two words have a table of single words.

The tables are flat arrays over word numbers: about 40 bytes for a benchmark word. They are built once
for each Python worker. A benchmark beyond ``PASS_BYTES`` is searched in several passes, one after
the other; what each finds is written, and the documents themselves are not.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, fresh, mapped, words_of, worker_table, written

WINDOW = 10
#: Benchmark words, in bytes, that one search holds; a larger benchmark is searched in several passes.
PASS_BYTES = 16 << 20
#: Longer items are cut into pieces that overlap by all but one word of a window.
PIECE_BYTES = 1 << 20
#: Words that a bucket's key is made of.
TAIL = 4
_MIX, _LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _pair(a, b):
    """A hash of two word numbers, for Python integers and for arrays alike."""
    return (a * 0x9E3779B1 ^ b * 0x85EBCA77) & 0x7FFFFFFF


def _tail_key(numbers: list[int]) -> int:
    key = 0
    for n in numbers:
        key = (key * _MIX + n + 1) & _LOW
    return key


class WuManber:
    """All windows of one length over numbered words. ``find`` gives (position, window number)."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int):
        """words: word numbers of all pieces end to end; starts, ends: where each piece lies; every piece holds
        at least ``size`` words. Equal windows have one number: the place of the first of them in ``at``."""
        self.size, self.block = size, min(2, size)
        self.far, self.tail = size - self.block + 1, min(TAIL, size)
        inside = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        # Names of ever longer runs of words, by pairs of names: windows are equal where their names are.
        name, span = words.astype(np.int64), 1
        while span < size:
            step = min(span, size - span)
            following = np.zeros(len(name), np.int64)
            following[: len(name) - step] = name[step:]
            name = np.unique(name * (following.max() + 1) + following, return_inverse=True)[1]
            span += step
        _, first, self.number = np.unique(name[inside], return_index=True, return_inverse=True)
        self.places = inside
        keys = np.zeros(len(first), np.uint64)
        at = inside[first]
        for k in range(size - self.tail, size):
            keys = keys * np.uint64(_MIX) + words[at + k].astype(np.uint64) + np.uint64(1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.bucket = keys[order], order.astype(np.int32)
        self.at, self.words = at, words
        if self.block == 2:
            bits = max(10, int(4 * len(words)).bit_length())
            self.mask = (1 << bits) - 1
            shift = np.full(1 << bits, self.far, np.uint8)
            # A pair at the end of some window allows no move; before a piece's first window ends, as far as to there.
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                move = np.maximum(0, size - 1 - np.arange(1, b - a)).astype(np.uint8)
                np.minimum.at(shift, _pair(words[a : b - 1].astype(np.int64), words[a + 1 : b].astype(np.int64)) & self.mask, move)
            self.shift = shift.tobytes()

    def _windows(self, numbers: list[int]) -> Iterator[int]:
        """Numbers of the windows that are these words: the bucket of their tail, compared directly."""
        key = _tail_key(numbers[-self.tail :])
        k = bisect_left(self.keys, key)
        while k < len(self.keys) and int(self.keys[k]) == key:
            window = int(self.bucket[k])
            at = int(self.at[window])
            if self.words[at : at + self.size].tolist() == numbers:
                yield window
            k += 1

    def find(self, words: list[bytes], number) -> list[tuple[int, int]]:
        """``number`` gives a word's number, or None for a word of no window."""
        found, size, n = [], self.size, len(words)
        if self.block == 1:
            return [(k, w) for k in range(n) if (x := number(words[k])) is not None for w in self._windows([x])]
        shift, mask = self.shift, self.mask
        at = size - 1
        while at < n:
            last = number(words[at])
            if last is None:  # no window holds this place
                at += size
                continue
            before = number(words[at - 1])
            if before is None:
                at += size - 1
                continue
            move = shift[_pair(before, last) & mask]
            if move:
                at += move
                continue
            run = [number(w) for w in words[at - size + 1 : at + 1]]
            if None not in run:
                found.extend((at - size + 1, w) for w in self._windows(run))
            at += 1
        return found


class Searcher:
    """All windows of benchmark pieces (item, words): one table for each window length."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        self.known: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces})
        rank = {item: k for k, item in enumerate(self.items)}
        by_size: dict[int, list[tuple[int, list[int]]]] = {}
        known = self.known
        for item, text in pieces:
            numbers = [known.setdefault(w, len(known)) for w in words_of(text)]
            if numbers:
                by_size.setdefault(min(window, len(numbers)), []).append((rank[item], numbers))
        self.tables: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        for size, rows in sorted(by_size.items()):
            lengths = np.array([len(x) for _, x in rows])
            ends = np.cumsum(lengths)
            words = np.concatenate([np.array(x, np.int32) for _, x in rows])
            table = WuManber(words, ends - lengths, ends, size)
            # Which items own each window, as one list with the windows' bounds in it.
            owner = np.repeat(np.array([r for r, _ in rows]), lengths - size + 1)
            pairs = np.unique(table.number.astype(np.int64) * len(self.items) + owner)
            window_of, owners = pairs // len(self.items), (pairs % len(self.items)).astype(np.int32)
            self.tables.append((table, np.searchsorted(window_of, np.arange(len(table.at) + 1)), owners))
            del table.number, table.places

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where windows stand in a text, and the items that own them."""
        spans, met = [], set()
        number = self.known.get
        for table, bounds, owners in self.tables:
            windows = set()
            for at, window in table.find(words, number):
                spans.append((at, at + table.size))
                windows.add(window)
            for w in windows:
                met.update(owners[bounds[w] : bounds[w + 1]].tolist())
        return spans, {self.items[k] for k in met}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(window: int, most: int = PIECE_BYTES):
    """(item, text) to (item, words): lower-case words with single spaces, in pieces of about ``most`` bytes
    that hold every window; nothing for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                at = 0
                while at < len(words):
                    end, size = at, 0
                    while end < len(words) and (size < most or end - at < window):
                        size += len(words[end]) + 1
                        end += 1
                    items.append(item)
                    pieces.append(b" ".join(words[at:end]))
                    if end == len(words):
                        break
                    at = end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])

    return run


def _passes(benchmark: DataFrame, window: int, pass_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct pieces in parts that fit the bound, by a hash of the piece."""
    distinct = benchmark.select(F.coalesce(column_or_null(benchmark, "item_id", "string"), F.lit("")).alias("item"), column_or_null(benchmark, "text", "binary").alias("text")).distinct()
    pieces = mapped(distinct, _cut(window, min(PIECE_BYTES, max(1, pass_bytes // 16))), "item string, words binary").distinct()
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    if size <= pass_bytes:
        return [pieces]
    pieces, parts = written(pieces), -(-2 * int(size) // pass_bytes)
    return [pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k) for k in range(parts)]


def _worker_searcher(shared, token: str, window: int) -> Searcher:
    """The worker's tables of a broadcast benchmark: built once, and dropped for those of the next pass."""
    return worker_table(token, lambda: Searcher(shared.value, window))


class _Pass:
    """One part of the benchmark, broadcast while its documents are searched; its size is bounded by the part."""

    def __init__(self, part: DataFrame, window: int):
        rows = [(x["item"], bytes(x["words"])) for x in part.collect()]
        self.shared, self.token, self.window = part.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex, window

    def searcher(self):
        shared, token, window = self.shared, self.token, self.window
        return lambda: _worker_searcher(shared, token, window)


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = "n_words bigint, spans array<struct<a:int,b:int>>, item_ids array<string>"


def _found(searcher, lead: list[str], only_hits: bool = False):
    """Rows (lead..., text) to (lead..., n_words, spans, item_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = searcher()
            counts, spans, items = [], [], []
            for text in batch.column(len(lead)):
                words = words_of(text.as_py())
                hit, met = s.spans(words)
                counts.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in _merged(hit)])
                items.append(sorted(met))
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(lead)], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=[*lead, "n_words", "spans", "item_ids"])
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, spans of all passes, items of all passes) with the spans merged and the items sorted."""
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in _merged([(x["a"], x["b"]) for part in row for x in part])] for row in batch.column(2).to_pylist()]
        items = [sorted({x for part in row for x in part}) for row in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["h1", "h2", "spans", "item_ids"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([len(words_of(x.as_py())) for x in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts], names=["doc_id", "h1", "h2", "n_words"])


def _hashes(text) -> list:
    """Two 64-bit hashes of a text, which name it where what several passes found is put together."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _hits(texts: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """(h1, h2, spans, item_ids) of each different text with a hit. One pass at a time: a part's broadcast
    and the workers' tables go before the next part comes, and only hits are written."""
    found = []
    for part in parts:
        now = _Pass(part, window)
        hits = mapped(texts.select("h1", "h2", "text"), _found(now.searcher(), ["h1", "h2"], only_hits=True), f"h1 bigint, h2 bigint, {_FOUND}", holds=now.token)
        found.append(written(hits.groupBy("h1", "h2").agg(F.first("spans").alias("spans"), F.first("item_ids").alias("item_ids"))))
        now.shared.destroy()
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    # As many short lists for a text as there are passes.
    every = every.groupBy("h1", "h2").agg(F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("item_ids"))
    return written(mapped(every, _joined, "h1 bigint, h2 bigint, spans array<struct<a:int,b:int>>, item_ids array<string>"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (hit word positions, end exclusive, merged), item_ids (as
    strings, sorted).

    A window is ``window`` consecutive words of an item; an item with fewer, but not none, is one
    window. Null and wordless texts have no words, hits or items; null item ids count as one item
    with an empty name; repeated items count once, repeated documents each. Texts are searched whole,
    however long. An empty benchmark hits nothing, an empty table gives no rows. Other columns,
    whatever their names, are not read. A part of the benchmark is collected and broadcast only below
    ``pass_bytes`` of words; more is searched in further passes over the documents.
    """
    source = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "binary").alias("text"))
    parts = _passes(benchmark, window, pass_bytes)
    if len(parts) == 1:
        now = _Pass(parts[0], window)
        return mapped(source, _found(now.searcher(), ["doc_id"]), f"doc_id bigint, {_FOUND}", holds=now.token)
    h1, h2 = _hashes(F.col("text"))
    texts = source.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    counted = mapped(texts, _count_words, "doc_id bigint, h1 bigint, h2 bigint, n_words bigint")
    none = lambda kind: F.expr("array()").cast(kind)
    return counted.join(_hits(texts, parts, window), ["h1", "h2"], "left").select(
        "doc_id", "n_words", F.coalesce("spans", none("array<struct<a:int,b:int>>")).alias("spans"), F.coalesce("item_ids", none("array<string>")).alias("item_ids")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; rows as find_contamination has them."""
    found = find_contamination(docs, benchmark, window, pass_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + (x["b"] - x["a"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows in which any benchmark window occurs; columns unchanged, whatever their names.
    Null and wordless texts stay, and so does every row where the benchmark is empty."""
    parts = _passes(benchmark, window, pass_bytes)
    if len(parts) > 1:
        names = [fresh("_h1", docs), fresh("_h2", docs)]
        text = column_or_null(docs, "text", "binary")
        texts = docs.select(*(h.alias(n) for h, n in zip(_hashes(text), ("h1", "h2"), strict=True)), text.alias("text"))
        hits = _hits(texts, parts, window).select(F.col("h1").alias(names[0]), F.col("h2").alias(names[1]))
        named = docs.select("*", *(h.alias(n) for h, n in zip(_hashes(text), names, strict=True)))
        return named.join(hits, names, "left_anti").select(*docs.columns)
    now, at = _Pass(parts[0], window), docs.columns.index("text")
    searcher = now.searcher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = searcher()
            yield batch.filter(pa.array([not s.spans(words_of(x.as_py()))[0] for x in batch.column(at).cast(pa.binary())], pa.bool_()))

    return mapped(docs, run, docs.schema, holds=now.token)


__all__ = ["Searcher", "WuManber", "contamination_report", "drop_contaminated", "find_contamination"]

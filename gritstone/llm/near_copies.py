"""Near copies by word shingles: SimHash tiles propose pairs, exact Jaccard similarity confirms them.

Used where near duplicates are asked for by similarity (five words, 0.8 or more) and not by a
Hamming radius. Texts with the same shingle set are one class. Classes meet in blocks: each takes
``BLOCKS`` block keys, the smallest of its shingles under as many mixed hashes, so two classes of
similarity s miss each other with probability (1 - s) ** BLOCKS: 3.2e-4 at 0.8. In a block,
tiles of fingerprints of the sets are compared by XOR and bit counts within ``RADIUS`` (at 0.8 similarity about
10 of 64 bits differ, four standard deviations below it), and every pair left is confirmed on the
whole shingle sets. Set members are 32-bit hashes: among n shingles some n * n / 2**33 coincide, which moves a
similarity only where it lies within that many members of the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, fresh, mapped, written
from .components import connected_components
from .simhash import _Forest, _links, fingerprint, near_pairs, shingle_hashes, tile_units, unit_cuts

BLOCKS = 5
RADIUS = 22
#: Shingle sets are wide, so tiles hold fewer rows than those of bare fingerprints.
TILE = 1024
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1) for k in range(BLOCKS)], np.uint64)


def _mixed(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A permutation of 64-bit values (SplitMix64's finaliser), another for each seed. A product with
    an odd number alone is not enough: the smallest of g * h is often that of 3g * h, 5g * h too."""
    x = hashes ^ seed
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _body():
    """A hash of a row's text, null for a null text: with the id it tells which row stands for a class."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "binary").alias("text")).withColumn("body", _body())


def _profile(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Per row: doc_id, body (hash of the text), node (hash of its shingle set), fp, size, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, prints, blocks, size = [], [], [], []
            for text in batch.column(1):
                # The fingerprint is of the set too: with repeats it would say nothing about the sets' similarity.
                distinct = np.unique(shingle_hashes(text.as_py(), shingle_words))
                node.append(_node(distinct))
                prints.append(np.uint64(fingerprint(distinct)).astype(np.int64))
                blocks.append([int(_mixed(distinct, seed).min().astype(np.int64)) for seed in _SEEDS] if len(distinct) else None)
                size.append(len(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(prints, pa.int64()), pa.array(size, pa.int32()), pa.array(blocks, pa.list_(pa.int64()))],
                names=["doc_id", "body", "node", "fp", "size", "blocks"],
            )

    return mapped(_source(docs), run, "doc_id bigint, body bigint, node bigint, fp bigint, size int, blocks array<bigint>")


def _node(distinct: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(distinct.astype("<u8").tobytes()) - (1 << 63)


def _shingle_sets(shingle_words: int):
    """(text, node, fp) to (node, fp, shingles): the set as sorted 32-bit hashes, each node once for each task
    however often its row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, keep = [], []
            for value, node in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keep.append(node not in seen)
                seen.add(node)
                sets.append(np.unique(shingle_hashes(value.as_py(), shingle_words).astype(np.uint32)).astype("<u4").tobytes() if keep[-1] else None)
            rows = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=["node", "fp", "shingles"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return run


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (a, b) of shingle sets have Jaccard similarity of at least ``least``."""
    sizes = np.array([len(x) for x in sets])
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    good = low >= least * high
    for k in np.flatnonzero(good):
        x, y = sets[a[k]], sets[b[k]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        good[k] = both >= least * (len(x) + len(y) - both)
    return good


def _confirmed(fps: np.ndarray, nodes: np.ndarray, side: np.ndarray, raw: list[bytes], least: float) -> list[tuple[int, int]]:
    order = np.lexsort((nodes, np.bitwise_count(fps)))
    fps, nodes, side, raw = fps[order], nodes[order], side[order], [raw[k] for k in order]
    sets = [np.frombuffer(x, "<u4") for x in raw]
    left = np.flatnonzero(side == 0)
    crossed = bool(side.any())
    right = np.flatnonzero(side == 1) if crossed else left
    forest, links = _Forest(len(fps)), []
    for a, b in near_pairs(fps[left], fps[right], RADIUS):
        a, b = left[a], right[b]
        if not crossed:
            a, b = a[a < b], b[a < b]
        # Pairs already joined through others need no proof; the rest are proved a slice at a time.
        for k in range(0, len(a), 512):
            roots = forest.roots()
            x, y = a[k : k + 512], b[k : k + 512]
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
            for m in np.flatnonzero(_similar(sets, x, y, least)):
                if forest.join(int(x[m]), int(y[m])):
                    p, q = int(nodes[x[m]]), int(nodes[y[m]])
                    links.append((min(p, q), max(p, q)))
    return links


def _confirm_units(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def links():
            table = pa.Table.from_batches(held)
            if table.num_rows < 2:
                return []
            part = {n: table.column(n) for n in ("fp", "node", "side", "shingles")}
            return _confirmed(part["fp"].to_numpy().view(np.uint64), part["node"].to_numpy(), part["side"].to_numpy(), part["shingles"].to_pylist(), least)

        for batch in batches:
            for unit, start, end in unit_cuts(batch):
                if held and unit != now:
                    yield _links(links())
                    held = []
                now = unit
                held.append(batch.slice(start, end - start))
        if held:
            yield _links(links())

    return run


def near_copy_classes(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """Per row of docs: doc_id, body (hash of the text, null for a null text), component.

    Rows of one component are copies or near copies, directly or through others. Null, empty and
    blank texts have no shingles and form one component. Repeated rows and rows without an id are rows
    like others. Texts are read whole, however long; only doc_id and text are read. An empty table gives no rows.
    """
    rows = written(_profile(docs, shingle_words))
    # A class is represented by its smallest (id, text): with many null ids the id alone would stand for many texts.
    classes = rows.where("blocks is not null").groupBy("node").agg(F.min(F.struct("doc_id", "body")).alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.first("blocks").alias("blocks"))
    classes = written(classes)
    band = F.floor(F.log("size") / F.log(F.lit(1 / least))).cast("int").alias("pop")
    keyed = classes.select(F.posexplode("blocks").alias("k", "value"), "node", band)
    keyed = keyed.select(F.xxhash64("k", "value").alias("block"), "node", "pop")
    # Written, so that the join back stands on plain exchanges and a hot block's partition may be split.
    shared = written(keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"))
    met = written(keyed.join(shared, "block"))
    # Only classes that meet another are read again, one text of each, for their shingle sets.
    # Written, so that its size is known: where it is small Spark broadcasts it and no text is shuffled.
    needed = written(classes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("first.doc_id").alias("first_id"), F.col("first.body").alias("first_body"), "node", "fp"))
    source = _source(docs)
    again = source.join(needed, source["doc_id"].eqNullSafe(needed["first_id"]) & (source["body"] == needed["first_body"])).select("text", "node", "fp")
    wide = mapped(again, _shingle_sets(shingle_words), "node bigint, fp bigint, shingles binary")
    units = tile_units(met.join(wide, "node"), ["fp", "node", "shingles"], 1, tile, counted=met)
    linked = written(connected_components(mapped(units, _confirm_units(least), "a bigint, b bigint")))
    return rows.join(linked, "node", "left").select("doc_id", "body", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of near copies, columns unchanged: the one with the
    smallest doc_id (a null id only where there is no other), then the smallest text hash; of rows
    that agree in both, one.

    Null, empty and blank texts are one component, so one of them stays. Other columns may have any
    names and pass through unread. An empty table stays empty."""
    classes = near_copy_classes(docs, shingle_words, least)
    alike = classes.groupBy("component", "doc_id", "body").agg(F.count("*").alias("n"))
    first = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "n")).alias("x"))
    name, number, text_hash, mark = (fresh(c, docs) for c in ("_id", "_rows", "_body", "_text_hash"))
    keep = written(first.select(F.col("x.doc_id").alias(name), F.col("x.body").alias(text_hash), F.col("x.n").alias(number)))
    tagged = docs.withColumn(mark, F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("binary"))))
    kept = tagged.join(keep, tagged["doc_id"].eqNullSafe(keep[name]) & tagged[mark].eqNullSafe(keep[text_hash]))
    single = kept.where(F.col(number) == 1)
    several = kept.where(F.col(number) > 1).dropDuplicates(["doc_id", mark])
    return single.unionByName(several).select(*docs.columns)

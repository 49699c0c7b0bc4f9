"""SimHash near-duplicates: exact linking of fingerprints by tiles of XOR and bit counts.

Fingerprints are made from word shingles in one pass over the texts. Distinct fingerprints are
then compared inside *blocks* which provably bring every linked pair together:

* within a radius r, r + 1 disjoint bit fields cannot all differ (pigeonhole), so each fingerprint
  joins one block per field value;
* a block small enough for one tile is compared whole; a larger one is cut into tiles by
  population count and salt, and only tile pairs whose population counts differ by at most the
  radius are formed, since ``|popcount(a) - popcount(b)| <= distance(a, b)``. Each tile pair is a
  work unit of its own, so no block has to fit one task.

A unit returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped, shuffle_width, written
from .components import connected_components

#: Most fingerprints that one side of a work unit holds.
TILE = 4096
#: A work unit's name: two hashes of its block and tiles. One of 64 bits could give two units of a very large
#: table the same name, and a unit compared with itself would be taken for one of two sides.
UNIT = ("unit", "unit2")
#: Rows of a tile that are compared at once: 256 x 4096 distances are 1 MB.
ROWS = 256


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle, repeats included. Words are split at ASCII
    white space after lower-casing A-Z; fewer words make one shingle, none make none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[i:j], 42) for i, j in pairs), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set where more than half of the hashes have it; zero for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the unsigned fingerprint as a signed bigint, 0 for a null or blank text. Texts are read whole."""
    source = docs.select(column_or_null(docs, id_col, "bigint").alias("doc_id"), column_or_null(docs, text_col, "binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(shingle_hashes(text.as_py(), shingle_words)) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return mapped(source, run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- tiles


class _Forest:
    """Union-find over local positions, the smallest position as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        """The root of each position. Roots only ever point down, so following all at once ends soon."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, strip by strip. Both sides are sorted by population
    count, so each strip meets only the rows whose count is within the radius of its own."""
    pop_l, pop_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), ROWS):
        part = left[i : i + ROWS]
        low = np.searchsorted(pop_r, pop_l[i] - radius, "left")
        high = np.searchsorted(pop_r, pop_l[min(i + ROWS, len(left)) - 1] + radius, "right")
        for j in range(low, high, TILE):
            other = right[j : min(j + TILE, high)]
            a, b = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
            if len(a):
                yield a + i, b + j


def unit_links(fps: np.ndarray, nodes: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one unit. Sides 0 and 1 are compared across; where side is
    all 0 the tile is compared with itself."""
    order = np.lexsort((nodes, np.bitwise_count(fps)))
    fps, nodes, side = fps[order], nodes[order], side[order]
    left = np.flatnonzero(side == 0)
    crossed = bool(side.any())
    right = np.flatnonzero(side == 1) if crossed else left
    forest, links = _Forest(len(fps)), []
    for a, b in near_pairs(fps[left], fps[right], radius):
        a, b = left[a], right[b]
        if not crossed:
            a, b = a[a < b], b[a < b]
        # Pairs already joined through others are passed over a slice at a time, not one by one.
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            roots = forest.roots()
            apart = roots[x] != roots[y]
            for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if forest.join(p, q):
                    links.append((min(int(nodes[p]), int(nodes[q])), max(int(nodes[p]), int(nodes[q]))))
    return links


def unit_cuts(batch: pa.RecordBatch) -> list[tuple[tuple[int, int], int, int]]:
    """(unit, start, end) of the runs of equal units in a batch sorted by ``UNIT``."""
    if not batch.num_rows:
        return []
    a, b = (batch.column(name).to_numpy() for name in UNIT)
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return [((int(a[i]), int(b[i])), int(i), int(j)) for i, j in zip(starts, np.r_[starts[1:], len(a)], strict=True)]


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _units(radius: int):
    """Rows (unit, fp, node, side) sorted by unit, whole units in one partition: links per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, out = None, []

        def flush():
            nonlocal held
            if held:
                rows = np.concatenate(held, axis=1)
                held = []
                if rows.shape[1] > 1:
                    out.extend(unit_links(rows[0].view(np.uint64), rows[1], rows[2], radius))

        for batch in batches:
            rows = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("fp", "node", "side")])
            for unit, start, end in unit_cuts(batch):
                if unit != now:
                    flush()
                now = unit
                held.append(rows[:, start:end])
            if len(out) >= 1 << 14:
                yield _links(out)
                out.clear()
        flush()
        if out:
            yield _links(out)

    return run


def tile_units(keyed: DataFrame, carried: list[str], reach: int, tile: int = TILE, counted: DataFrame | None = None) -> DataFrame:
    """Deal rows (block, pop, node, carried...) to work units of at most two tiles.

    A block of up to ``tile`` rows is one unit. A larger one is cut into tiles by ``pop`` and a
    salt; each pair of tiles whose ``pop`` differ by at most ``reach`` is a unit, with the rows of
    one tile on side 0 and of the other on side 1. Returns (unit, unit2, carried..., side), units whole
    within a partition and sorted. ``counted`` may give the same (block, pop) rows without what is
    carried, to be counted in its place.
    """
    width = shuffle_width(keyed.sparkSession)
    sizes = (keyed if counted is None else counted).groupBy("block", "pop").agg(F.count("*").alias("n")).groupBy("block").agg(
        F.sum("n").alias("size"), F.map_from_arrays(F.collect_list("pop"), F.collect_list(F.ceil(F.col("n") / tile).cast("int"))).alias("salts")
    ).where("size > 1")
    # Written, so that both sides of the join are plain exchanges and AQE may split a hot block's partition.
    sizes = written(sizes.select("block", "size", F.when(F.col("size") > tile, F.col("salts")).alias("salts")))
    rows = keyed.join(sizes, "block")
    named = lambda *parts: [F.xxhash64(F.lit(k), *parts).alias(name) for k, name in enumerate(UNIT)]
    small = rows.where("salts is null").select(*named(F.col("block")), *carried, F.lit(0).cast("byte").alias("side"))
    # A row of a large block goes to each tile pair that its own tile belongs to.
    large = rows.where("salts is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.element_at("salts", F.col("pop"))).cast("int"))
    near = F.expr(f"filter(flatten(transform(map_entries(salts), e -> transform(sequence(0, e.value - 1), s -> struct(e.key as pop, s as salt)))), t -> abs(t.pop - pop) <= {reach})")
    large = large.withColumn("other", F.explode(near))
    own, other = F.struct("pop", "salt"), F.struct(F.col("other.pop"), F.col("other.salt"))
    large = large.select(*named(F.col("block"), F.least(own, other), F.greatest(own, other)), *carried, (own > other).cast("byte").alias("side"))
    return small.unionByName(large).repartition(width, *UNIT).sortWithinPartitions(*UNIT)


def links_in_blocks(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """keyed (block, fp, node), a node at most once in a block: links (a, b), a < b, as forests."""
    keyed = keyed.withColumn("pop", F.bit_count("fp"))
    units = tile_units(keyed, ["fp", "node"], radius, tile)
    return mapped(units, _units(radius), "a bigint, b bigint")


def _fields(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 disjoint bit fields of 64 bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:], strict=False)]


def hamming_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp) rows in, the same rows out with component_id: the smallest doc_id reachable by
    links of at most ``radius`` differing bits. Rows with equal fingerprints are one class, whatever
    their number; a class of only null ids keeps a null component unless it links to another."""
    prints = written(prints.select("doc_id", "fp"))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # A class without an id still needs a node; negative nodes sort below real ids, so the ids come back by min().
    nodes = classes.select("fp", "low", F.xxhash64("fp").alias("node"))
    fields = F.array(*[
        F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))) for k, (shift, mask) in enumerate(_fields(radius))
    ])
    keyed = nodes.select(F.explode(fields).alias("block"), "fp", "node")
    linked = connected_components(links_in_blocks(keyed, radius))
    grouped = nodes.join(linked, "node")
    named = grouped.join(grouped.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("fp", "component_id")
    # Written for the same reason: one fingerprint may be that of a third of all rows.
    full = written(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return prints.join(full, "fp", "left")


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lower-case hex digits), component_id.

    Empty, blank and null texts have fingerprint zero and are linked like any other. Texts are read whole, however
    long. Repeated rows stay repeated; an empty table gives no rows. Other columns of the input, whatever their
    names, are not read.
    """
    found = hamming_components(fingerprints(docs, shingle_words, id_col, text_col), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a sample that grows with the table up to a bound, and so do its leaves in number;
every row is then assigned to a leaf by walking down. A query walks the tree with a priority queue:
it goes down to the nearest child, keeps the other children in the queue by their distance, and
opens the nearest of them when it has reached a leaf. Leaf visits are widened until a calibration set,
whose true neighbours are found by brute force over all rows, reaches the recall asked for, and for
each query until the leaves hold enough rows. Inner products are turned into distances by one more
coordinate that gives all vectors the same length, so the order of visits fits vectors of any norm.

Equal vectors are one class, searched and asked for once: of its rows only the smallest ids can be
among anyone's nearest. Leaves are dealt to units of bounded size; queries travel to the units whose
leaves they open and stream through them, so no row is copied and no list of queries is held.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, mapped, shuffle_width, written

#: Rows that the tree is fitted on: a tenth of the table between these bounds. Children of a node.
LEAST_SAMPLE, MOST_SAMPLE, BRANCH = 20_000, 100_000, 8
#: Rows of the table that a leaf is aimed at, and the bounds of what that may be in the sample.
LEAF_ROWS, LEAST_LEAF, MOST_LEAF = 1024, 16, 256
#: Queries whose true neighbours calibrate the leaf visits, and the recall they must reach.
CALIBRATION, RECALL = 256, 0.97
#: Bounds of the rows of a work unit.
LEAST_UNIT, MOST_UNIT = 1024, 65_536


class Tree:
    """Nodes with centres; a leaf has a number. Small: its size depends on the sample only."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = MOST_LEAF, seed: int = 7):
        self.children: list[np.ndarray] = []  # node numbers, empty for a leaf
        self.centres: list[np.ndarray] = []  # of the children
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, branch, leaf_rows, np.random.default_rng(seed))

    def _grow(self, rows: np.ndarray, branch: int, leaf_rows: int, rng: np.random.Generator) -> int:
        node = len(self.leaf)
        self.children.append(np.zeros(0, np.int64))
        self.centres.append(np.zeros((0, rows.shape[1])))
        self.leaf.append(-1)
        parts = self._split(rows, branch, rng) if len(rows) > leaf_rows else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        self.centres[node] = np.stack([p.mean(axis=0) for p in parts])
        self.children[node] = np.array([self._grow(p, branch, leaf_rows, rng) for p in parts])
        return node

    @staticmethod
    def _split(rows: np.ndarray, branch: int, rng: np.random.Generator) -> list[np.ndarray]:
        centres = rows[rng.choice(len(rows), min(branch, len(rows)), replace=False)]
        for _ in range(12):
            own = np.argmin(_distances(rows, centres), axis=1)
            there = np.unique(own)
            new = np.stack([rows[own == k].mean(axis=0) for k in there])
            if new.shape == centres.shape and np.allclose(new, centres):
                break
            centres = new
        own = np.argmin(_distances(rows, centres), axis=1)
        return [rows[own == k] for k in np.unique(own)]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            near = np.argmin(_distances(rows[at], self.centres[node]), axis=1)
            todo.extend((int(child), at[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any())
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which best-bin-first opens them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                away = ((self.centres[node] - query) ** 2).sum(axis=1)
                best = int(np.argmin(away))
                for k, child in enumerate(self.children[node].tolist()):
                    if k != best:
                        heapq.heappush(queue, (float(away[k]), child))
                node = int(self.children[node][best])
            yield self.leaf[node]


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * rows @ centres.T


def _lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    return np.c_[rows, np.sqrt(np.maximum(0.0, norm**2 - (rows**2).sum(axis=1)))]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _best(rows: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], query: np.ndarray, k: int, unique: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the rows of the classes ``rows`` that can be among the k nearest whatever one id is
    left out: by score and id k + 1 rows where ids are unique, else k rows of an id and 2 k in all. The scores
    given only propose classes: the measure is summed anew, in one order for all, so that it depends on
    the vectors alone."""
    most = k + 1 if unique else 2 * k
    if len(scores) > most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        there = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge)))
    else:
        there = np.arange(len(scores))
    exact = (rows[there] * query).sum(axis=1)
    held = [ids[t] for t in there]
    every = np.concatenate(held) if held else np.zeros(0, np.int64)
    measure = np.repeat(exact, [len(x) for x in held])
    order = np.lexsort((every, -measure))
    every, measure = every[order], measure[order]
    if not unique and len(np.unique(every)) < len(every):  # rank within each id
        by_id = np.argsort(every, kind="stable")
        first = np.r_[True, every[by_id][1:] != every[by_id][:-1]]
        rank = np.empty(len(every), np.int64)
        rank[by_id] = np.arange(len(every)) - np.maximum.accumulate(np.where(first, np.arange(len(every)), 0))
        every, measure = every[rank < k], measure[rank < k]
    return every[:most], measure[:most]


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, float, int]:
    """(vec_id, v) of the rows that take part, their number of components, largest norm and count."""
    rows = table.select(column_or_null(table, id_col, "bigint").alias("vec_id"), column_or_null(table, vector_col, "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).where(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    seen = rows.agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least"), F.max(norm).alias("norm"), F.count("*").alias("n")).first()
    if seen["most"] != seen["least"]:
        raise ValueError(f"vectors of {seen['least']} to {seen['most']} components")
    return rows, seen["most"] or 0, seen["norm"] or 0.0, seen["n"]


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): equal vectors with the ids that can be among the k nearest of any query, whichever id that has:
    k rows of an id and the smallest 2 k in all. Only rows whose vector's hash another row has are shuffled; their
    ranks are limited before that too, so a vector that a third of the rows share does not gather in one task."""
    hashed = rows.withColumn("h", F.xxhash64("v"))
    twice = written(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    alone = hashed.join(twice, "h", "left_anti").select("v", F.array("vec_id").alias("ids"))
    same = hashed.join(twice, "h", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "vec_id").orderBy("vec_id"))).where(F.col("r") <= k)
    small = same.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= 2 * k)
    return alone.unionByName(small.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids"))


def _unit_search(size: int, k: int, unique: bool):
    """Rows (unit, side, v, ids, leaf, rep, open) sorted by unit and side, whole units in a partition: side 0 the
    unit's classes, side 1 the queries with those of its leaves that they open. Gives (rep, ids,
    scores) for each query of each unit. Only one unit's classes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        rows = ids = spans = None

        def build():
            t = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(t.column("leaf").to_numpy(), kind="stable")
            vectors = _matrix(t.column("v").combine_chunks(), size)[order]
            lists = t.column("ids").take(pa.array(order)).combine_chunks()
            flat, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            leaf = t.column("leaf").to_numpy()[order]
            first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            ends = np.r_[first[1:], len(leaf)]
            return vectors, [flat[a:b] for a, b in zip(edges - edges[0], (edges - edges[0])[1:], strict=False)], {int(leaf[a]): (a, b) for a, b in zip(first, ends, strict=True)}

        def ask(part: pa.RecordBatch):
            out = []
            for rep, query, opened in zip(part.column("rep").to_pylist(), _matrix(part.column("v"), size), part.column("open").to_pylist(), strict=True):
                there = [spans[x] for x in opened if x in spans]
                if there:
                    near = np.concatenate([rows[a:b] for a, b in there]) if len(there) > 1 else rows[there[0][0] : there[0][1]]
                    lists = [x for a, b in there for x in ids[a:b]]
                    out.append((rep, *_best(near, near @ query, lists, query, k, unique)))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["rep", "ids", "scores"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(unit)], strict=True):
                part = batch.slice(start, end - start)
                if unit[start] != now:
                    now, held, rows, spans = unit[start], [], None, {}
                if side[start] == 0:
                    held.append(part)
                    continue
                if held:
                    (rows, ids, spans), held = build(), []
                yield ask(part)

    return run


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest rows (largest inner product) of each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (the inner product in double precision); ties go
    to the smaller id. All rows but the query's own (by id) are candidates. Vectors that are null, zero
    or hold nulls or non-finite components, and rows without an id, take no part. Rows that repeat an
    id are candidates each; queries are distinct rows by id, the first of equals by vector. A query
    has fewer than k rows only where there are not that many candidates. An empty table gives an empty
    result; vectors of different lengths are an error. Other columns, whatever their names, are not read.
    """
    spark = table.sparkSession
    rows, size, norm, n = _vectors(table, id_col, vector_col)
    if not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = _fit(rows, size, norm, n)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_lifted(_matrix(batch.column(0), size), norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["v", "ids", "leaf"])

    placed = written(mapped(_classes(rows, k), leaves, "v array<double>, ids array<bigint>, leaf int"))
    unique = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    asked = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v")))
    # Queries with equal vectors are asked once, under the smallest of their ids.
    groups = written(asked.groupBy("h", "v").agg(F.min("vec_id").alias("rep")))
    visits = _calibrate(placed, groups, tree, size, norm, k, recall)
    met = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()  # a row for each leaf
    classes, ids = {r["leaf"]: r["n"] for r in met}, {r["leaf"]: r["ids"] for r in met}
    width = shuffle_width(spark)
    unit_rows = min(MOST_UNIT, max(LEAST_UNIT, sum(classes.values()) // (4 * width)))
    first, salts = _shards([classes.get(leaf, 0) for leaf in range(tree.leaves)], unit_rows)

    def opens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, opened = [], []
            for x in _directions(_matrix(batch.column(1), size), norm):
                by_unit: dict[int, list[int]] = {}
                enough, made = 0, 0
                for leaf in tree.visits(x):
                    for unit in range(first[leaf], first[leaf] + salts[leaf]):
                        by_unit.setdefault(unit, []).append(leaf)
                    made, enough = made + 1, enough + ids.get(leaf, 0)
                    # The query's own rows may be among those counted.
                    if made >= visits and enough > 2 * k:
                        break
                units.append(list(by_unit))
                opened.append(list(by_unit.values()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.list_(pa.int64())), pa.array(opened, pa.list_(pa.list_(pa.int32())))], names=["rep", "v", "units", "opened"])

    # Proportional to the leaves, which the sample bounds.
    shards = F.broadcast(spark.createDataFrame([(leaf, first[leaf], salts[leaf]) for leaf in range(tree.leaves)], "leaf int, first bigint, salts int"))
    unit = (F.col("first") + F.pmod(F.xxhash64("v"), F.col("salts"))).alias("unit")
    left = placed.join(shards, "leaf").select(unit, F.lit(0).alias("side"), "v", "ids", "leaf", F.lit(None).cast("bigint").alias("rep"), F.lit(None).cast("array<int>").alias("open"))
    sent = mapped(groups.select("rep", "v"), opens, "rep bigint, v array<double>, units array<bigint>, opened array<array<int>>")
    sent = sent.select("rep", "v", F.explode(F.arrays_zip("units", "opened")).alias("x"))
    right = sent.select(F.col("x.units").alias("unit"), F.lit(1).alias("side"), "v", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("int").alias("leaf"), "rep", F.col("x.opened").alias("open"))
    units = left.unionByName(right).repartition(width, "unit").sortWithinPartitions("unit", "side")
    found = mapped(units, _unit_search(size, k, unique), "rep bigint, ids array<bigint>, scores array<double>")
    return _nearest_of(found, asked, groups, k)


def _fit(rows: DataFrame, size: int, norm: float, n: int) -> Tree:
    """A tree on a tenth of the rows, LEAST_SAMPLE to MOST_SAMPLE of them, picked by hash."""
    wanted = min(MOST_SAMPLE, max(LEAST_SAMPLE, n // 10))
    share = int(min(1.0, wanted / max(1, n)) * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share) if n > wanted else rows
    sample = picked.select("v").limit(2 * MOST_SAMPLE).toArrow()  # about `wanted` rows
    vectors = np.unique(_matrix(sample.column("v").combine_chunks(), size), axis=0)
    leaf_rows = int(min(MOST_LEAF, max(LEAST_LEAF, LEAF_ROWS * len(vectors) / max(1, n))))
    return Tree(_lifted(vectors, norm), leaf_rows=leaf_rows)


def _directions(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Queries in the lifted space: only their direction counts, and their own lift is zero."""
    lifted = np.c_[vectors, np.zeros(len(vectors))]
    return lifted * (norm / np.sqrt((lifted**2).sum(axis=1, keepdims=True)))


def _shards(sizes: list[int], rows: int) -> tuple[list[int], list[int]]:
    """(first unit, number of units) of each leaf: a large leaf has several of its own, small ones that
    follow each other share one."""
    first, salts, shard, room = [], [], 0, rows
    for n in sizes:
        if n > rows:
            if room < rows:
                shard, room = shard + 1, rows
            first.append(shard)
            salts.append(-(-n // rows))
            shard += salts[-1]
        else:
            if n > room:
                shard, room = shard + 1, rows
            first.append(shard)
            salts.append(1)
            room -= n
    return first, salts


def _nearest_of(found: DataFrame, asked: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The best k of each query from its units' lists, without its own id: as many short lists as it met units."""
    pairs = F.arrays_zip(F.transform("scores", lambda x: -x).alias("neg"), F.col("ids").alias("id"))
    lists = written(found.select("rep", pairs.alias("p")).groupBy("rep").agg(F.flatten(F.collect_list("p")).alias("p")))
    named = asked.join(groups, ["h", "v"]).select("vec_id", "rep")
    best = named.join(lists, "rep").withColumn("p", F.filter("p", lambda x: x["id"] != F.col("vec_id")))
    best = best.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.array_sort("p"), 1, k)).alias("rank", "x"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))


def _true_neighbours(placed: DataFrame, asked: list[int], vectors: np.ndarray, size: int, k: int) -> list[list[tuple[int, int]]]:
    """(id, leaf) of the true k nearest of a bounded set of queries, by brute force over all classes."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists, leaf = _matrix(batch.column(0), size), batch.column(1), batch.column(2).to_pylist()
            scores = vectors @ rows.T
            for q, own in enumerate(asked):
                # One more class than neighbours: one may hold the query alone.
                near = np.argpartition(-scores[q], k)[: k + 1] if len(rows) > k + 1 else np.arange(len(rows))
                new = [(-float(scores[q, c]), i, leaf[c]) for c in near.tolist() for i in lists[c].as_py() if i != own]
                best[q] = sorted(best[q] + new)[:k]
        flat = [(q, s, i, f) for q, rows in enumerate(best) for s, i, f in rows]
        columns = list(zip(*flat, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["q", "s", "vec_id", "leaf"])

    top = mapped(placed.select("v", "ids", "leaf"), brute, "q int, s double, vec_id bigint, leaf int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("s", "vec_id"))
    out: list[list[tuple[int, int]]] = [[] for _ in asked]
    for r in top.withColumn("r", rank).where(F.col("r") <= k).select("q", "vec_id", "leaf").collect():  # k rows a query
        out[r["q"]].append((r["vec_id"], r["leaf"]))
    return out


def _queries(groups: DataFrame, size: int, salt: int, most: int) -> tuple[list[int], np.ndarray]:
    """At most ``most`` queries, picked by hash."""
    asked = groups.select("rep", "v").orderBy(F.xxhash64("rep", F.lit(salt))).limit(most).toArrow()
    return asked.column("rep").to_pylist(), _matrix(asked.column("v").combine_chunks(), size) if asked.num_rows else np.zeros((0, size))


def _calibrate(placed: DataFrame, groups: DataFrame, tree: Tree, size: int, norm: float, k: int, recall: float) -> int:
    """Leaf visits that find ``recall`` of the true neighbours of a bounded set of queries."""
    asked, vectors = _queries(groups, size, 1, CALIBRATION)
    if not asked:
        return 1
    when = []
    for direction, true in zip(_directions(vectors, norm), _true_neighbours(placed, asked, vectors, size, k), strict=True):
        rank = {leaf: m for m, leaf in enumerate(tree.visits(direction), 1)}
        when.extend(rank[leaf] for _, leaf in true)
    # Widen visit by visit: the smallest number with which enough true neighbours are met.
    return int(np.quantile(np.array(when), recall, method="higher")) if when else 1


def measured_recall(table: DataFrame, found: DataFrame, k: int = 20, every: int = 20, queries: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of true neighbours that a search found, over queries that did not calibrate it (all others
    where there are few; not a number where there are none). Brute force over all rows."""
    rows, size, _, _ = _vectors(table, id_col, vector_col)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = asked.groupBy("v").agg(F.min("vec_id").alias("rep"))
    used = set(_queries(groups, size, 1, CALIBRATION)[0])
    ids, vectors = _queries(groups, size, 2, queries + len(used))
    fair = [m for m, i in enumerate(ids) if i not in used][:queries]
    ids, vectors = [ids[m] for m in fair], vectors[fair]
    if not ids:
        return float("nan")
    true = _true_neighbours(rows.select("v", F.array("vec_id").alias("ids"), F.lit(0).alias("leaf")), ids, vectors, size, k)
    met: dict[int, set[int]] = {}
    for r in found.where(F.col("query_id").isin(ids)).select("query_id", "vec_id").collect():  # k rows a query
        met.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(met.get(i, set()) & {n for n, _ in t}) for i, t in zip(ids, true, strict=True)) / max(1, sum(map(len, true)))

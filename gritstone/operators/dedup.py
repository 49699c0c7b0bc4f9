"""Exact and near duplicates of sentences with an auditable mapping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import l2_normalised, strip
from ..session import durable, ship
from .components import connected_components


def normalised(c: Column) -> Column:
    """For exact comparison: no tags, lower case, single spaces, no final punctuation."""
    s = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    s = strip(F.regexp_replace(s, r"(?U)\s+", " "))
    return strip(F.regexp_replace(s, r"[;,.!?]+$", ""))


def lightly_normalised(c: Column) -> Column:
    """Stripped, lower case, white space to single spaces."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def exact_dedup(df: DataFrame, text_col: str, row: str = "row_index") -> DataFrame:
    """Add exact_rep, the smallest row with the same normalised text, and is_exact_rep.

    Texts meet by a digest of 16 bytes. The smallest rows are found by partial aggregation and written, so the
    join back stands on plain exchanges and AQE may split a text that fills a third of the table."""
    keyed = df.withColumn("_norm", F.unhex(F.md5(normalised(F.col(text_col)).cast("binary"))))
    first = durable(keyed.groupBy("_norm").agg(F.min(row).alias("exact_rep")))
    return keyed.join(first, "_norm").drop("_norm").withColumn("is_exact_rep", F.col("exact_rep") == F.col(row))


#: Most pivots of the similarity search, and rows of one side of a tile.
PIVOTS, TILE = 256, 1024


#: Rings are at least this wide, so that their number has a bound whatever the threshold.
RING = 0.02


def _around(centres: np.ndarray, angle: float):
    """(id, u) to (pivot, home, band, id, u): each row once as its nearest pivot's own, and once for each pivot where it
    may meet another's. Bands are rings around the pivot, no narrower than ``angle``."""
    width = max(angle, RING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _matrix(batch.column(1))
            away = np.arccos(np.clip(u @ centres.T, -1, 1))
            nearest = away.argmin(axis=1)
            # A row within ``angle`` of this one lies nearer to its own pivot than to this row's, so this row is
            # at most twice ``angle`` further from that pivot than from its own.
            at, pivot = np.nonzero(away <= (away[np.arange(len(u)), nearest] + 2 * angle)[:, None])
            band = np.floor(away[at, pivot] / width).astype(np.int32)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(nearest[at] == pivot), pa.array(band), batch.column(0).take(rows), batch.column(1).take(rows)], names=["pivot", "home", "band", "id", "u"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _tile_pairs(threshold: float):
    """Rows (t1, t2, side, id, u) sorted by tile pair, whole pairs in a partition: (a, b, sim) of close rows. Block
    products propose; the cosine is summed anew in one order, so it depends on the two rows alone."""

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        u = _matrix(t.column("u").combine_chunks())
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y = np.nonzero(u[l] @ u[r].T >= threshold - 1e-9) if len(l) and len(r) else (np.zeros(0, int), np.zeros(0, int))
        x, y = l[x], r[y]
        keep = ids[x] < ids[y]
        x, y = x[keep], y[keep]
        sim = np.concatenate([(u[x[k : k + 65536]] * u[y[k : k + 65536]]).sum(axis=1) for k in range(0, len(x), 65536)]) if len(x) else np.zeros(0)
        good = sim >= threshold
        return pa.RecordBatch.from_arrays([pa.array(ids[x[good]]), pa.array(ids[y[good]]), pa.array(sim[good])], names=["a", "b", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(t1)], strict=True):
                unit = (t1[start], t2[start])
                if held and unit != now:
                    yield compare(held)
                    held = []
                now = unit
                held.append(batch.slice(start, end - start))
        if held:
            yield compare(held)

    return run


def similarity_edges(vectors: DataFrame, threshold: float, row: str = "row_index", vector: str = "embedding", pivots: int | None = None, tile: int = TILE) -> DataFrame:
    """All pairs (a < b) of rows whose cosine is at least the threshold, with sim. Exact.

    Rows gather around pivots, which are rows picked by hash: each is its nearest pivot's own, and visits the others
    where, by the triangle inequality of angles, it may be within reach of one of theirs. Around a
    pivot, rings as wide as the threshold's angle are cut into tiles; a tile of own rows meets the
    tiles of rows that stand in its ring or the next ones. No task holds more than two tiles, however
    many rows are alike. A threshold of wide angle leaves little to prune, and has one pivot."""
    spark = vectors.sparkSession
    ship(spark)
    unit = durable(vectors.where(F.col(vector).isNotNull()).select(F.col(row).cast("bigint").alias("id"), l2_normalised(F.col(vector)).alias("u")))
    angle = math.acos(max(-1.0, min(1.0, threshold))) * (1 + 1e-9) + 1e-7
    if pivots is None:
        pivots = 1 if 4 * angle >= math.pi else max(1, min(PIVOTS, unit.count() // (4 * tile)))
    picked = unit.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(pivots).select("u").collect()  # PIVOTS rows at most
    schema = "a bigint, b bigint, sim double"
    if not picked:
        return spark.createDataFrame([], schema)
    centres = np.array([r["u"] for r in picked])
    placed = durable(unit.mapInArrow(_around(centres, angle), "pivot int, home boolean, band int, id bigint, u array<double>"))
    # Tiles of own rows (side 0) and of all rows (side 1) in each ring. A row for each pivot and ring: small by construction.
    counts = placed.groupBy("pivot", "band").agg(F.count("*").alias("n"), F.count_if("home").alias("own"))
    tiles = lambda c: F.ceil(F.col(c) / tile).cast("int")
    rings = counts.groupBy("pivot").agg(F.map_from_arrays(F.collect_list("band"), F.collect_list(tiles("n"))).alias("all"), F.map_from_arrays(F.collect_list("band"), F.collect_list(tiles("own"))).alias("own"))
    rows = placed.join(F.broadcast(rings), "pivot")
    salt = lambda side: F.pmod(F.xxhash64("id", F.lit(side)), F.element_at("own" if side == 0 else "all", F.col("band"))).cast("int")
    named = lambda band, s: F.struct(F.col("pivot"), band.alias("band"), s.alias("salt"))
    near = lambda side: F.expr(f"flatten(transform(array(band - 1, band, band + 1), b -> transform(filter(sequence(0, greatest(coalesce(try_element_at({side}, b), 0) - 1, 0)), s -> coalesce(try_element_at({side}, b), 0) > 0), s -> struct(b as band, s as salt))))")
    key = lambda s: F.xxhash64(s)
    left = rows.where("home").withColumn("o", F.explode(near("`all`")))
    left = left.select(key(named(F.col("band"), salt(0))).alias("t1"), key(F.struct("pivot", F.col("o.band"), F.col("o.salt"))).alias("t2"), F.lit(0).alias("side"), "id", "u")
    right = rows.withColumn("o", F.explode(near("own")))
    right = right.select(key(F.struct("pivot", F.col("o.band"), F.col("o.salt"))).alias("t1"), key(named(F.col("band"), salt(1))).alias("t2"), F.lit(1).alias("side"), "id", "u")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = left.unionByName(right).repartition(width, "t1", "t2").sortWithinPartitions("t1", "t2")
    return units.mapInArrow(_tile_pairs(threshold), schema)


#: Edges up to which the leader rule goes to the components at once, and rounds that larger graphs take before.
FEW_EDGES, ROUNDS = 2_000_000, 3


def _lead_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, x, y) sorted, y < x or null: the rows x that lead. Rows are visited in order and only the
    leaders of one component are remembered."""
    component, leaders = None, set()
    row, free = None, True

    def settle(found):
        if row is not None and free:
            leaders.add(row)
            found.append(row)

    for batch in batches:
        found: list[int] = []
        for c, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (c, x) != (component, row):
                settle(found)
                if c != component:
                    leaders.clear()
                component, row, free = c, x, True
            if y is not None and y in leaders:
                free = False
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["lead"])
    last: list[int] = []
    settle(last)
    yield pa.RecordBatch.from_arrays([pa.array(last, pa.int64())], names=["lead"])


def _leaders(edges: DataFrame, few: int, rounds: int) -> DataFrame:
    """(lead) of a symmetric table of edges (a, b).

    Large graphs first take a few rounds in which every open row without a smaller open neighbour leads and
    its neighbours follow; groups of near copies are settled by these. What stays open, chains at worst,
    is visited in order, component by component, in one sorted pass: no number of rounds is a limit."""
    spark = edges.sparkSession
    open_edges, leaders = edges, None
    for _ in range(rounds):
        if open_edges.count() <= few:
            break
        low = durable(open_edges.groupBy("a").agg(F.min("b").alias("low")))
        new = low.where("a < low").select(F.col("a").alias("lead"))
        gone = durable(new.unionByName(open_edges.join(new, open_edges["a"] == new["lead"]).select(F.col("b").alias("lead"))).distinct())
        left = durable(open_edges.join(gone, open_edges["a"] == gone["lead"], "left_anti").join(gone, F.col("b") == F.col("lead"), "left_anti"))
        # A row whose open neighbours have all gone leads itself.
        alone = low.select(F.col("a").alias("lead")).join(gone, "lead", "left_anti").join(left.select(F.col("a").alias("lead")).distinct(), "lead", "left_anti")
        now = durable(new.unionByName(alone))
        leaders = now if leaders is None else leaders.unionByName(now)
        open_edges = left
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = durable(connected_components(open_edges.where("a < b").select("a", "b")))
    down = open_edges.where("b < a").select(F.col("a").alias("x"), F.col("b").alias("y"))
    # Every row once for itself, so that those without a smaller neighbour are visited too.
    each = found.select(F.col("node").alias("x"), F.lit(None).cast("bigint").alias("y"))
    visited = down.unionByName(each).join(found, F.col("x") == F.col("node")).select("component", "x", "y")
    dealt = visited.repartition(width, "component").sortWithinPartitions("component", "x", "y")
    rest = durable(dealt.mapInArrow(_lead_in_order, "lead bigint"))
    return rest if leaders is None else leaders.unionByName(rest)


def leader_clusters(rows: DataFrame, edges: DataFrame, row: str = "row_index", few: int = FEW_EDGES, rounds: int = ROUNDS) -> DataFrame:
    """Sequential leader clustering, distributed: (row, rep, sim).

    Visiting rows in order, an unassigned row leads and takes all its unassigned neighbours. So a row leads
    where no smaller neighbour does, and each other row belongs to its smallest leading neighbour."""
    ship(rows.sparkSession)
    both = durable(edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")))
    leaders = _leaders(both.select("a", "b"), few, rounds)
    ids = rows.select(F.col(row).alias("row"))
    led = both.join(leaders, both["b"] == leaders["lead"]).groupBy("a").agg(F.min(F.struct("b", "sim")).alias("m"))
    led = durable(led.join(leaders, led["a"] == leaders["lead"], "left_anti").select("a", F.col("m.b").alias("rep"), F.col("m.sim").alias("sim")))
    return ids.join(led, ids["row"] == led["a"], "left").select("row", F.coalesce("rep", "row").alias("rep"), F.coalesce("sim", F.lit(1.0)).alias("sim"))


def dedup_mapping(df: DataFrame, text_col: str, vector: str = "embedding", threshold: float = 0.97, row: str = "row_index") -> DataFrame:
    """row_index, rep_index, is_representative, sim_to_rep, cluster_size: exact duplicates first, then near
    ones among their representatives; an exact duplicate takes over its representative's similarity."""
    exact = durable(exact_dedup(df, text_col, row).select(row, vector, "exact_rep", "is_exact_rep"))
    reps = exact.where("is_exact_rep").select(row, vector)
    led = leader_clusters(reps, similarity_edges(reps, threshold, row, vector), row)
    full = exact.select(F.col(row).alias("row_index"), "exact_rep").join(led, F.col("exact_rep") == F.col("row"))
    full = full.select("row_index", F.col("rep").alias("rep_index"), (F.col("row_index") == F.col("rep")).alias("is_representative"), F.col("sim").alias("sim_to_rep"))
    full = durable(full)
    sizes = durable(full.groupBy("rep_index").agg(F.count("*").alias("cluster_size")))
    return full.join(sizes, "rep_index").select("row_index", "rep_index", "is_representative", "sim_to_rep", "cluster_size")


def with_attributes(df: DataFrame, key: str, attributes: DataFrame, row: str = "row_index", prefix: str = "") -> DataFrame:
    """df with the attributes of the rows that ``key`` names, their columns prefixed; the first row of each id."""
    names = [c for c in attributes.columns if c != row]
    one = attributes.dropDuplicates([row]).select(F.col(row).alias("_of"), *[F.col(f"`{c}`").alias(prefix + c) for c in names])
    return df.join(one, F.col(key) == F.col("_of"), "left").drop("_of")


def worst_members(mapping: DataFrame, attributes: DataFrame | None = None, row: str = "row_index") -> DataFrame:
    """Per representative the least similar member (ties: the smallest row), with its ``worst_member_`` attributes
    where a table of them is given."""
    members = mapping.where("row_index <> rep_index")
    worst = members.groupBy("rep_index").agg(F.min(F.struct("sim_to_rep", "row_index")).alias("w")).select("rep_index", F.col("w.row_index").alias("worst_member_row_index"), F.col("w.sim_to_rep").alias("worst_sim"))
    return worst if attributes is None else with_attributes(worst, "worst_member_row_index", attributes, row, "worst_member_")


def review(mapping: DataFrame, attributes: DataFrame | None = None, row: str = "row_index") -> DataFrame:
    """Per representative: cluster size, statistics of its members' similarity, the worst member and, where a table of
    them is given, the attributes of the representative and of that member. Without members the
    minimum and mean are 1 and the rest is null."""
    members = mapping.where("row_index <> rep_index")
    q = F.percentile("sim_to_rep", F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5)))
    stats = members.groupBy("rep_index").agg(F.min("sim_to_rep").alias("min_sim"), F.max("sim_to_rep").alias("max_sim"), F.avg("sim_to_rep").alias("mean_sim"), q.alias("q"))
    reps = mapping.where("is_representative").select("rep_index", "cluster_size")
    out = reps.join(stats, "rep_index", "left").join(worst_members(mapping).drop("worst_sim"), "rep_index", "left")
    out = out.select(
        "rep_index", "cluster_size", F.coalesce("min_sim", F.lit(1.0)).alias("min_sim"), "max_sim", F.coalesce("mean_sim", F.lit(1.0)).alias("mean_sim"),
        F.get("q", 0).alias("p05_sim"), F.get("q", 1).alias("p25_sim"), F.get("q", 2).alias("p50_sim"), "worst_member_row_index",
    )
    if attributes is None:
        return out
    return with_attributes(with_attributes(out, "rep_index", attributes, row, "rep_"), "worst_member_row_index", attributes, row, "worst_member_")


def least_similar(mapping: DataFrame, per_cluster: int = 10, attributes: DataFrame | None = None, row: str = "row_index") -> DataFrame:
    """The members least like their representative, up to ``per_cluster`` each, with their rank and, where a table of
    them is given, the attributes of both sides (``rep_`` and ``mem_``)."""
    w = Window.partitionBy("rep_index").orderBy("sim_to_rep", "row_index")
    ranked = mapping.where("row_index <> rep_index").withColumn("rank_in_cluster", F.row_number().over(w))
    out = ranked.where(F.col("rank_in_cluster") <= per_cluster).select("rep_index", "row_index", "cluster_size", "sim_to_rep", F.col("rank_in_cluster").cast("bigint").alias("rank_in_cluster"))
    if attributes is None:
        return out
    return with_attributes(with_attributes(out, "rep_index", attributes, row, "rep_"), "row_index", attributes, row, "mem_")

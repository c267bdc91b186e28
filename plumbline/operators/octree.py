"""Lossless octree over points, and its store: every point is owned by exactly one node.

Two passes over the points, level by level. The topology pass splits a node if more than
`capacity` points reach it; its first `capacity` in file order stop there. The ownership
pass routes all points again: a split node keeps every k-th arrival, k the number that
reached it over the capacity, up to its capacity, so that it is an even sample; other nodes
keep all that reach them. Nodes first seen in the second pass are kept like any other.

Only a point's number and its cell path travel, three bits a level; attributes are joined once at
the end. Levels are done by Spark while more than `local` points reach a node: an arrival's
number in its node is then its rank within a block of consecutive records plus the node's
count in the blocks before, so that no such node's points meet in one task. A subtree that at
most `local` points reach is finished in one task with numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.sources.tables import materialize

CAPACITY, MAX_DEPTH, MIN_EXTENT = 100_000, 16, 1e-3
#: Records whose ranks are taken together, and points of a subtree that one task finishes.
BLOCK, LOCAL = 1 << 20, 1 << 20
#: Levels of a cell path.
DEPTH = 16

NODE = ("level", "nx", "ny", "nz")


def cube(low: tuple[float, float, float], high: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The cube around the bounds' centre with their largest extent."""
    half = max(max(b - a for a, b in zip(low, high)), 1e-9) / 2
    middle = [(a + b) / 2 for a, b in zip(low, high)]
    return tuple(m - half for m in middle), tuple(m + half for m in middle)


def path_of(x: np.ndarray, y: np.ndarray, z: np.ndarray, low: tuple, high: tuple) -> np.ndarray:
    """The child of each level that holds a point, three bits each, the root's first; a point on the middle belongs to the upper half. Bounds are numbers or arrays."""
    whole = lambda a, v: np.array(np.broadcast_to(np.asarray(a, np.float64), len(v)))
    ends = [(v, whole(a, v), whole(b, v)) for v, a, b in zip((x, y, z), low, high)]
    path = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        child = np.zeros(len(x), np.int64)
        for k, (v, a, b) in enumerate(ends):
            middle = (a + b) / 2
            upper = v >= middle
            np.copyto(a, middle, where=upper)
            np.copyto(b, middle, where=~upper)
            child |= upper.astype(np.int64) << k
        path = path << 3 | child
    return path


def cell_of(path: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nx, ny, nz of the node of each path at a level."""
    out = [np.zeros(len(path), np.int64) for _ in "xyz"]
    for depth in range(DEPTH):
        inside = depth < level
        child = path >> 3 * (DEPTH - 1 - depth) & 7
        for k, n in enumerate(out):
            np.copyto(n, n << 1 | child >> k & 1, where=inside)
    return out[0], out[1], out[2]


def paths(points: DataFrame, low: tuple, high: tuple, order: str = "idx") -> DataFrame:
    """(idx, path) of all points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, z = (b.column(d).to_numpy(zero_copy_only=False) for d in "xyz")
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array(path_of(x, y, z, low, high))], ["idx", "path"])

    told = points.select(F.col(order).cast("long").alias("idx"), *[F.col(d).cast("double").alias(d) for d in "xyz"])
    return told.mapInArrow(run, "idx long, path long")


def _ranks(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in file order: the nodes, each row's node by number, its arrival number there from 1, and the nodes' counts."""
    kinds, inverse, counts = np.unique(node, return_inverse=True, return_counts=True)
    by_node = np.argsort(inverse, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = np.empty(len(node), np.int64)
    rank[by_node] = np.arange(len(node)) - np.repeat(first, counts) + 1
    return kinds, inverse, rank, counts


def _splits(level: int, side: float, max_depth: int) -> bool:
    return level < min(max_depth, DEPTH) and side / 2**level > MIN_EXTENT


def _topology_below(capacity: int, max_depth: int, side: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        path, level, out = rows["path"].to_numpy(), int(rows["level"].iloc[0]), []
        while len(path):
            kinds, inverse, rank, counts = _ranks(path >> 3 * (DEPTH - level))
            split = (counts > capacity) & _splits(level, side, max_depth)
            out.append(pd.DataFrame({"level": level, "node": kinds, "traversed": counts, "split": split}))
            path = path[split[inverse] & (rank > capacity)]
            level += 1
        return pd.concat(out)

    return run


def _ownership_below(capacity: int):
    def run(key: tuple, rows: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        """Points of a subtree, and its split nodes `own` at levels `at`."""
        if not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("idx", "level", "nx", "ny", "nz")})
        known = {k: (g["own"].to_numpy(), g["traversed"].to_numpy()) for k, g in split.sort_values("own").groupby("at")}
        rows = rows.sort_values("idx")
        idx, path, level, out = rows["idx"].to_numpy(), rows["path"].to_numpy(), int(rows["level"].iloc[0]), []
        while len(idx):
            kinds, inverse, rank, _ = _ranks(path >> 3 * (DEPTH - level))
            nodes, traversed = known.get(level, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            at = np.minimum(np.searchsorted(nodes, kinds), max(len(nodes) - 1, 0))
            there = nodes[at] == kinds if len(nodes) else np.zeros(len(kinds), bool)
            step = np.where(there, np.maximum(1, traversed[at] // capacity) if len(nodes) else 1, 1)
            s = step[inverse]
            kept = ~there[inverse] | ((rank % s == 0) & (rank // s <= capacity))
            nx, ny, nz = cell_of(path[kept], np.full(kept.sum(), level))
            out.append(pd.DataFrame({"idx": idx[kept], "level": level, "nx": nx, "ny": ny, "nz": nz}))
            idx, path, level = idx[~kept], path[~kept], level + 1
        return pd.concat(out)

    return run


def _at(level: int) -> Column:
    return F.shiftright("path", 3 * (DEPTH - level)).alias("node")


def _arrivals(moving: DataFrame, block: int) -> DataFrame:
    """moving(idx, path, node) with rank, the number from 1 of each in its node by file order, and n, the node's points."""
    moving = moving.withColumn("block", F.floor(F.col("idx") / block).cast("long"))
    counts = moving.groupBy("node", "block").agg(F.count("*").alias("k"))
    before = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("node", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("node")).alias("n"))
    local = F.row_number().over(Window.partitionBy("node", "block").orderBy("idx"))
    return moving.withColumn("rank", local).join(offsets, ["node", "block"]).select("idx", "path", "node", (F.col("rank") + F.col("before")).alias("rank"), "n")


def _parted(moving: DataFrame, level: int, local: int) -> tuple[DataFrame, DataFrame | None]:
    """moving by its nodes of a level: rows (level, node, idx, path) of subtrees that one task can finish, and the rest, None if there is none."""
    moving = moving.withColumn("node", _at(level))
    sizes = materialize(moving.groupBy("node").agg(F.count("*").alias("n")), "node-sizes")
    if sizes.filter(F.col("n") > local).isEmpty():
        return moving.select(F.lit(level).alias("level"), "node", "idx", "path"), None
    told = moving.join(sizes, "node")
    small = told.filter(F.col("n") <= local).select(F.lit(level).alias("level"), "node", "idx", "path")
    return small, told.filter(F.col("n") > local).select("idx", "path", "node")


def topology(
    points: DataFrame, low: tuple, high: tuple, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, block: int = BLOCK, local: int = LOCAL
) -> DataFrame:
    """points(idx, path) -> (level, node, traversed, split) of every node that points reach; node is the path down to it."""
    side, moving, below, found = max(b - a for a, b in zip(low, high)), points, [], []
    for level in range(DEPTH + 1):
        small, large = _parted(moving, level, local)
        below.append(small)
        if large is None:
            break
        told = materialize(_arrivals(large, block), "arrivals")
        split = (F.col("n") > capacity) & F.lit(_splits(level, side, max_depth))
        found.append(told.groupBy("node").agg(F.count("*").alias("traversed"), F.max(split).alias("split")).select(F.lit(level).alias("level"), "node", "traversed", "split"))
        moving = told.filter(split & (F.col("rank") > capacity)).select("idx", "path")
    run = _topology_below(capacity, max_depth, side)
    found.append(reduce(DataFrame.union, below).groupBy("level", "node").applyInPandas(run, "level int, node long, traversed long, split boolean"))
    return reduce(DataFrame.union, found)


def own(
    points: DataFrame, low: tuple, high: tuple, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, block: int = BLOCK, local: int = LOCAL, order: str = "idx"
) -> DataFrame:
    """points with the node (level, nx, ny, nz) that owns each; their numbers in file order are distinct."""
    told = materialize(paths(points, low, high, order), "paths")
    split = topology(told, low, high, capacity, max_depth, block, local).filter("split").select("level", "node", "traversed")
    split, moving, below, found = materialize(split, "split-nodes"), told, [], []
    for level in range(DEPTH + 1):
        small, large = _parted(moving, level, local)
        own_split = split.withColumn("at", F.col("level")).filter(F.col("at") >= level)
        # A split node belongs to the subtree whose root its path passes at this level.
        roots = own_split.select(F.lit(level).alias("level"), F.expr(f"shiftright(node, 3 * (at - {level}))").alias("node"), F.col("at"), F.col("node").alias("own"), "traversed")
        kind = "idx long, level int, nx long, ny long, nz long"
        below.append(small.groupBy("level", "node").cogroup(roots.groupBy("level", "node")).applyInPandas(_ownership_below(capacity), kind))
        if large is None:
            break
        arrived = materialize(_arrivals(large, block).join(split.filter(F.col("level") == level).select("node", "traversed"), "node", "left"), "arrivals")
        step = F.greatest(F.lit(1), F.floor(F.col("traversed") / capacity))
        kept = F.col("traversed").isNull() | ((F.col("rank") % step == 0) & (F.floor(F.col("rank") / step) <= capacity))
        found.append(arrived.filter(kept).select("idx", F.lit(level).alias("level"), "path"))
        moving = arrived.filter(~kept).select("idx", "path")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nx, ny, nz = cell_of(b["path"].to_numpy(), b["level"].to_numpy())
            yield pd.DataFrame({"idx": b["idx"], "level": b["level"], "nx": nx, "ny": ny, "nz": nz})

    every = below + ([reduce(DataFrame.union, found).mapInPandas(cells, "idx long, level int, nx long, ny long, nz long")] if found else [])
    owners = materialize(reduce(DataFrame.union, every), "owners")  # read more than once by those who sort or count them
    return points.join(owners.withColumnRenamed("idx", order), order).select(*points.columns, *NODE)


def prefix_counts(points: DataFrame, low: tuple, high: tuple, depth: int) -> DataFrame:
    """(level, nx, ny, nz, n): points below every node down to a depth, on the bounds as they are. Points are counted once, in the deepest nodes."""
    deepest = paths(points, low, high).groupBy(_at(depth)).agg(F.count("*").alias("n"))
    up = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    told = deepest.select(up.alias("level"), "node", "n").groupBy("level", F.expr(f"shiftright(node, 3 * ({depth} - level))").alias("node")).agg(F.sum("n").alias("n"))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            level = b["level"].to_numpy()
            nx, ny, nz = cell_of(b["node"].to_numpy() << 3 * (DEPTH - level).astype(np.int64), level)
            yield pd.DataFrame({"level": level, "nx": nx, "ny": ny, "nz": nz, "n": b["n"]})

    return told.mapInPandas(cells, "level int, nx long, ny long, nz long, n long")


def node_table(owned: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """(level, nx, ny, nz, key, point_count, min_x .. max_z) of the nodes that own points."""
    n = owned.groupBy(*NODE).agg(F.count("*").alias("point_count"))
    size = {d: F.lit(b - a) / F.pow(F.lit(2.0), F.col("level")) for d, a, b in zip("xyz", low, high)}
    bounds = [(F.lit(float(a)) + (F.col(f"n{d}") + k) * size[d]).alias(f"{m}_{d}") for m, k in (("min", 0), ("max", 1)) for d, a in zip("xyz", low)]
    return n.select(*NODE, F.concat_ws("-", *NODE).alias("key"), "point_count", *bounds)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_index(owned: DataFrame, folder: str, low: tuple, high: tuple, source_count: int, **told) -> None:
    """The store of an octree: points by level, clustered by node and in file order; nodes; and last, if no point is lost, the manifest with its marker."""
    spark = owned.sparkSession
    if _exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise FileExistsError(f"{folder} holds an index")
    ordered = owned.repartitionByRange(*NODE).sortWithinPartitions(*NODE, "idx")
    ordered.write.partitionBy("level").parquet(f"{folder}/points")
    stored = spark.read.parquet(f"{folder}/points")
    node_table(stored, low, high).write.parquet(f"{folder}/nodes")
    total = spark.read.parquet(f"{folder}/nodes").agg(F.coalesce(F.sum("point_count"), F.lit(0))).first()[0]
    if total != source_count:
        raise ValueError(f"{total} points stored of {source_count}")
    manifest = json.dumps({"version": 2, "low": low, "high": high, "point_count": total, **told})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a finished index; one without its marker was not finished."""
    if not _exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"{folder} holds no finished index")
    return json.loads(spark.read.parquet(f"{folder}/manifest").first()[0])


def write_surfels(surfels: DataFrame, folder: str, spacing: str | None = None, **told) -> None:
    """A store of surfels(level, nx, ny, nz, ...): tiles by level, clustered by node; a row a tile; and last the manifest with its marker.

    spacing names a column whose mean over the tiles goes into the manifest."""
    spark = surfels.sparkSession
    if _exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise FileExistsError(f"{folder} holds surfels")
    kept = materialize(surfels, "surfels")
    kept.repartitionByRange(*NODE).sortWithinPartitions(*NODE).write.partitionBy("level").parquet(f"{folder}/surfels")
    mean = F.avg(spacing) if spacing else F.lit(None).cast("double")
    spark.read.parquet(f"{folder}/surfels").groupBy(*NODE).agg(F.count("*").alias("surfel_count"), mean.alias("spacing")).write.parquet(f"{folder}/nodes")
    total, tiles, wide = spark.read.parquet(f"{folder}/nodes").agg(F.coalesce(F.sum("surfel_count"), F.lit(0)), F.count("*"), F.avg("spacing")).first()
    if total != kept.count():
        raise ValueError(f"{total} surfels stored of {kept.count()}")
    manifest = json.dumps({"version": 1, "surfel_count": total, "tiles": tiles, "spacing": wide or 0.0, **told})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.parquet(f"{folder}/manifest")


def read_surfels(spark: SparkSession, folder: str, tiles: DataFrame | None = None) -> DataFrame:
    """The stored surfels, or those of tiles(level, nx, ny, nz)."""
    read_manifest(spark, folder)
    found = spark.read.parquet(f"{folder}/surfels")
    return found if tiles is None else found.join(tiles.select(*NODE), list(NODE), "left_semi")


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    read_manifest(spark, folder)
    return spark.read.parquet(f"{folder}/nodes")


def read_points(spark: SparkSession, folder: str, low: tuple | None = None, high: tuple | None = None, levels: tuple[int, int] | None = None) -> DataFrame:
    """The stored points, of a box and of a range of levels if given. Levels prune folders; nodes and the points' own bounds prune row groups."""
    nodes, points = read_nodes(spark, folder), spark.read.parquet(f"{folder}/points")
    if levels:
        points = points.filter(F.col("level").between(*levels))
    if low is None or high is None:
        return points
    box = {b: F.col(b) for b in nodes.columns if b[:4] in ("min_", "max_")}
    met = nodes.filter(geo.overlaps(box, {f"{m}_{d}": F.lit(float(v)) for m, corner in (("min", low), ("max", high)) for d, v in zip("xyz", corner)}))
    inside = points.filter(geo.in_box(F.col("x"), F.col("y"), F.col("z"), low, high))
    return inside.join(met.select(*NODE), list(NODE), "left_semi")

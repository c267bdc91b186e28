"""Preview octrees of many clouds: which nodes there are, their numbers in post-order, and an even sample of each leaf.

All is done over relations, without a walk. Points are counted once, in the cells of the deepest level; a cell counts for
each of its ancestors. A node is there if it is the root or its parent is split, which the parent's count tells, since counts never grow on
the way down. A node's number is the size of its subtree, and the sizes of the subtrees of all earlier siblings of
itself and of its ancestors: sizes are counts of descendants, and sums over earlier siblings are a window over at most eight rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import copies, octree
from plumbline.operators import points as pts
from plumbline.sources.tables import materialize

# Points over which a node is split, levels below the root, and the extent under which no node is split.
LEAF_POINTS, DEPTH, MIN_EXTENT = 50_000, 7, 1e-3
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Quality:
    """Points that a leaf keeps at most, and the stride of its sample: `stride` halved at each level, `least` at least."""

    cap: int
    stride: int
    least: int

    def stride_at(self, level: Column) -> Column:
        return F.greatest(F.lit(self.least), F.floor(F.lit(self.stride) / F.pow(F.lit(2.0), level)).cast("int"))


# Fixed values.
QUALITIES = {"fast": Quality(50_000, 4096, 128), "balanced": Quality(50_000, 512, 16), "all-detail": Quality(200_000, 64, 1)}


def bounds(points: DataFrame) -> DataFrame:
    """(cloud, min_x .. max_z)"""
    return points.groupBy("cloud").agg(*[f(d).alias(f"{n}_{d}") for n, f in (("min", F.min), ("max", F.max)) for d in AXES])


def cells(points: DataFrame, of: DataFrame, depth: int = DEPTH) -> DataFrame:
    """points with `cell`, the path of the cell of the deepest level, three bits a level; of: the bounds of the clouds."""
    names = [f"{m}_{d}" for m in ("min", "max") for d in AXES]
    sides = points.join(of.select("cloud", *names), "cloud")
    kept = [c for c in points.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float)
            path = octree.path_of(*(at(d) for d in AXES), tuple(at(f"min_{d}") for d in AXES), tuple(at(f"max_{d}") for d in AXES))
            held = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*held, pa.array(path >> 3 * (octree.DEPTH - depth))], [*kept, "cell"])

    return sides.mapInArrow(run, points.withColumn("cell", F.lit(0).cast("long")).schema)


def _up(node: Column | str, levels: Column | int) -> Column:
    """The ancestor of a node so many levels up."""
    node = F.col(node) if isinstance(node, str) else node
    return F.floor(node / F.pow(F.lit(8), levels if isinstance(levels, Column) else F.lit(levels))).cast("long")


def topology(counts: DataFrame, of: DataFrame, capacity: int = LEAF_POINTS, depth: int = DEPTH) -> DataFrame:
    """(cloud, id, level, node, parent_id, point_count, leaf, subtree) of the nodes of each cloud; counts: (cloud, cell, n) at the deepest level.

    Ids count from 1 in post-order, children by octant."""
    extent = F.greatest(*[F.col(f"max_{d}") - F.col(f"min_{d}") for d in AXES])
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    summed = counts.select("cloud", "cell", "n", levels.alias("level")).groupBy("cloud", "level", _up("cell", F.lit(depth) - F.col("level")).alias("node")).agg(F.sum("n").alias("point_count"))
    wide = of.select("cloud", extent.alias("extent"))
    splits = (F.col("point_count") > capacity) & (F.col("level") < depth) & (F.col("extent") / F.pow(F.lit(2.0), F.col("level")) > MIN_EXTENT)
    told = summed.join(wide, "cloud").withColumn("split", splits).drop("extent")
    # nodes and cells grow with the clouds, though their files are small: no broadcast of either
    parents = copies.spread(told.filter("split").select("cloud", (F.col("level") + 1).alias("level"), F.col("node").alias("up")))
    there = told.filter("level > 0").withColumn("up", _up("node", 1)).join(parents, ["cloud", "level", "up"], "left_semi").drop("up")
    nodes = materialize(told.filter("level = 0").unionByName(there), "preview-nodes")
    line = nodes.select("cloud", "level", "node", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at"))
    line = line.select("cloud", "level", "node", "at", _up("node", F.col("level") - F.col("at")).alias("above"))
    sizes = line.groupBy("cloud", F.col("at").alias("level"), F.col("above").alias("node")).agg(F.count("*").alias("subtree"))
    siblings = Window.partitionBy("cloud", "level", _up("node", 1)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.when(F.col("level") == 0, 0).otherwise(F.coalesce(F.sum("subtree").over(siblings), F.lit(0)))
    sized = materialize(sizes.withColumn("earlier", earlier), "preview-sizes")
    passed = line.join(copies.spread(sized.select("cloud", F.col("level").alias("at"), F.col("node").alias("above"), "earlier")), ["cloud", "at", "above"])
    before = passed.groupBy("cloud", "level", "node").agg(F.sum("earlier").alias("before"))
    found = nodes.join(copies.spread(sized.drop("earlier")), ["cloud", "level", "node"]).join(copies.spread(before), ["cloud", "level", "node"])
    found = materialize(found.select("cloud", (F.col("before") + F.col("subtree")).alias("id"), "level", "node", "point_count", (~F.col("split")).alias("leaf"), "subtree"), "preview-topology")
    above = copies.spread(found.select("cloud", (F.col("level") + 1).alias("level"), F.col("node").alias("up"), F.col("id").alias("parent_id")))
    return found.withColumn("up", F.when(F.col("level") > 0, _up("node", 1))).join(above, ["cloud", "level", "up"], "left").select("cloud", "id", "level", "node", "parent_id", "point_count", "leaf", "subtree")


def leaf_of(counts: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(cloud, cell, id, level): the leaf that holds each cell of the deepest level."""
    each = counts.select("cloud", "cell", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    each = each.withColumn("node", _up("cell", F.lit(depth) - F.col("level")))
    return each.join(copies.spread(nodes.filter("leaf").select("cloud", "level", "node", "id")), ["cloud", "level", "node"]).select("cloud", "cell", "id", "level")


def build(points: DataFrame, quality: str = "balanced", capacity: int = LEAF_POINTS, of: DataFrame | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, sample) of points(cloud, idx, x, y, z, ...): nodes as in `topology`; sample: the points that the leaves keep, with `id` of the
    leaf and lx, ly, lz relative to the middle of the cloud's bounds. A leaf's points are taken in file order, every stride-th, up to the cap."""
    q = QUALITIES[quality]
    of = materialize(of if of is not None else bounds(points), "preview-bounds")
    placed = cells(points, of, depth)
    counts = materialize(placed.groupBy("cloud", "cell").agg(F.count("*").alias("n")), "preview-counts")
    nodes = topology(counts, of, capacity, depth)
    taken = placed.filter(F.col("idx") % q.least == 0).join(copies.spread(leaf_of(counts, nodes, depth)), ["cloud", "cell"])
    taken = taken.filter(F.col("idx") % q.stride_at(F.col("level")) == 0)
    sample = pts.capped_sample(taken, 1, q.cap, "cloud", "id")
    middle = of.select("cloud", *[((F.col(f"min_{d}") + F.col(f"max_{d}")) * 0.5).alias(f"_{d}") for d in AXES])
    local = sample.join(middle, "cloud").withColumns({f"l{d}": F.col(d) - F.col(f"_{d}") for d in AXES})
    return nodes, local.drop("_x", "_y", "_z", "cell")


def summary(nodes: DataFrame, sample: DataFrame) -> DataFrame:
    """(cloud, max_depth, nodes, sampled, classes, returns, most_returns): classes and returns (but 0) that the samples hold, ascending."""
    whole = nodes.groupBy("cloud").agg(F.max("level").alias("max_depth"), F.count("*").alias("nodes"))
    kept = sample.groupBy("cloud").agg(
        F.count("*").alias("sampled"), F.array_sort(F.collect_set("classification")).alias("classes"),
        F.array_sort(F.collect_set(F.when(F.col("return_number") > 0, F.col("return_number")))).alias("returns"), F.greatest(F.max("number_of_returns"), F.lit(1)).alias("most_returns"),
    )
    return whole.join(kept, "cloud", "left").fillna(0, ["sampled"]).fillna(1, ["most_returns"])

"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


#: Tasks over which the neighbours of one node are dealt.
SALTS = 16


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs(u, v) with least(u, m), where each node's neighbours are dealt to SALTS tasks and its least stands in all of them."""
    dealt = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return dealt.join(copies, ["u", "s"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.filter("v > u"), least).filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), a != b -> (node, root), root the least node of the component; nodes without edges are absent.

    Every round is written to the shared folder. A node's least neighbour comes from an aggregate that is
    begun before the shuffle; to hear of it, the node's neighbours meet in SALTS tasks, which Spark may split further.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(mark):
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

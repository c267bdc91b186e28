"""Numbers in order within groups, whatever their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import materialize


def numbered(rows: DataFrame, order: list[str], *by: str, name: str = "number") -> DataFrame:
    """rows with their number from 1 in their group by order; a null group is a group, and order should tell rows apart.

    Rows are cut into ranges of group and order, so that a group of a third of all rows is many tasks; a row's number is its place in its range and the sizes of its group's ranges before.
    Ranges come from samples, which another run may draw otherwise: they are written before they are counted."""
    placed = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"))
    local = placed.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return local.join(before, same).select(*rows.columns, (F.col("_place") + F.col("_before")).alias(name))

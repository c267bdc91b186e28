"""World files of rasters, as columns: six numbers, or null where they are not six."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("dx", "row_shear", "column_shear", "dy", "x", "y")


def world_file(text: Column) -> Column:
    """struct of pixel sizes, shears and origin."""
    lines = F.filter(F.split(F.trim(text), "\\r?\\n"), lambda t: F.trim(t) != "")
    values = F.transform(lines, lambda t: F.trim(t).try_cast("double"))
    good = (F.size(values) == 6) & F.forall(values, lambda v: v.isNotNull())
    return F.when(good, F.struct(*[F.get(values, k).alias(n) for k, n in enumerate(PARTS)]))


def preferred(embedded: Column, beside: Column) -> Column:
    """The transform in the raster itself goes before that of a world file."""
    return F.coalesce(embedded, beside)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import materialize, shared_dir, table  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = "\\x09-\\x0D\\x20"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Names a row by id and text hash. Rows that agree in both are the same document."""
    return [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & left["__th"].eqNullSafe(right["__th"])

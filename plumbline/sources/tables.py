"""Tables of a scale directory, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only on one machine may it be unset, and then is a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage. options: of the writer, with _ for the dots of their names."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

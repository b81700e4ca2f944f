"""Where intermediate tables go."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="moderata-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Of encoded entries per row group of a table of long arrays.
ARRAY_BYTES = 1 << 20


def materialize(df: DataFrame, name: str, arrays: bool = False) -> DataFrame:
    """Write a frame that several jobs read, and read it back.

    Cuts the lineage and survives lost executors, which a cache would not. With
    ``arrays``, rows hold long arrays: row groups are small, as a reader unpacks
    up to 4 096 rows of one at once, some 20 times their size.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", ARRAY_BYTES) if arrays else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)

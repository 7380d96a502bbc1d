"""The folder that driver and executors share, for files that queries make, and how rows are dealt to Python tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder where that is unset, on local masters only (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, so that what is read more than once is made once."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Tasks for each core that groups are dealt to, at most.
TASKS = 3


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to some tasks for each core, no more than a shuffle has.

    Adaptive plans join small partitions by their bytes; groups that are few
    and small but take Python long would end up in one task, one after the
    other.  A number that is given stays.
    """
    spark = rows.sparkSession
    return rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism), *keys)

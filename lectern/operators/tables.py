"""What operators need of the cluster: the shared folder, cut lineage, checked broadcasts, parallel scans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share.

    Only where that is unset one is chosen here: a temporary one for a local
    master, else one beside the warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and sc.master.startswith("local") and "cluster" not in sc.master:
            own = tempfile.mkdtemp(prefix="lectern-checkpoints-")
        sc.setCheckpointDir(own or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_few(df: DataFrame, rows: int = FEW) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; a larger one joins by a shuffle. ``df`` should be cheap to read twice."""
    return F.broadcast(df) if is_few(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores: a file that can't be split would keep all but one idle. Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

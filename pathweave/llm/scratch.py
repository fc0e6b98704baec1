"""Shared scratch folder for tables that cut lineage.

On a cluster the folder is the one named by ``spark.checkpoint.dir``; a folder
of this machine is set only where that setting is absent (tests, local mode).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Setting of Spark (from 4.1; others ignore it) by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of a write: beside that one, Arrow batches of a size that leaves room for what a worker makes of them.
_SETTINGS = {_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    from tempfile import gettempdir

    own = f"file://{gettempdir()}/pathweave-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/pathweave-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and its path for remove().

    Later jobs start from the files, so a lost executor never costs more than
    the running stage, and the optimizer sees true sizes.  The shuffle files of
    the write go when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """As stored(), for a table that the caller does not remove."""
    return stored(df, name)[0]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later job reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

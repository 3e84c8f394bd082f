"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's checkpoint folder. Where neither is set: with a local master, as in tests on one
    machine, a local folder; on a cluster a RuntimeError, as its machines would each write to their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file:///tmp/quarry-{os.getuid()}-{spark.sparkContext.applicationId}"
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the stored table.

    This cuts the lineage: a lost executor costs its tasks, not the work before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

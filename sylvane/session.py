"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=CONF)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, make a local one, but only for a local master."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not is_local(context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sylvane-checkpoint-", dir=os.environ.get("TMPDIR")))


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most so many bytes, where this Spark has that setting: a row may have whole blocks, and both processes hold batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key).removesuffix("b"))
    except Exception:  # no such setting, or one in other units
        return
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

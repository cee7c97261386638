"""Session settings that the operators are written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

#: UTC and ANSI arithmetic are assumed by the operators; AQE sizes shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "brindle", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster, pass SETTINGS to spark-submit instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", shuffle_partitions)
    spark = builder.config(map=SETTINGS).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session checkpoints to; a temporary one is set if there is none and master is local."""
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(folder)
    elif context.master.split("[")[0] == "local":
        made = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(f"file://{made}")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return context.getCheckpointDir()

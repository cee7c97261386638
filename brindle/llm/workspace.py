"""Tables in the folder that the driver and all executors share.

Lineage between the phases of an operator is cut by writing Parquet under
``spark.checkpoint.dir`` and reading it back, so the loss of an executor costs
the tasks of one phase at most.  The folder is read from the session; only
where none is configured and master is local (tests) a temporary one is set.
Shuffle files go as soon as the table they were for is written.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
#: Spark's setting that deletes the shuffle files of a query at its end; a table is written once and then only read.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='brindle-')}")
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, int | str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Workspace:
    """The tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd", batch_rows: int = 1024) -> DataFrame:
        """Write df as a table and return what is read back from it; its Arrow batches are kept small."""
        with _settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, FREE_SHUFFLES: "true"}):
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later phase reads."""
        for name in names:
            _remove(self.spark, self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a table as it is stored."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def partitions(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions of about ``each`` bytes, but not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def release(spark: SparkSession) -> None:
    """Delete all tables that operators have written for this session; results that still read them can't be used any more."""
    for made in [m for m in _MADE if m[0] is spark]:
        with contextlib.suppress(Exception):
            _remove(*made)
        _MADE.remove(made)

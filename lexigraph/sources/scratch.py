"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests, a laptop) gets a folder
    of its own; on a cluster that is an error, for executors could not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tasks that write a small table, for each core.
TASKS = 8
_MADE: list[Scratch] = []


def made() -> int:
    """How many scratch folders there have been, for :func:`sweep`."""
    return len(_MADE)


def sweep(since: int) -> None:
    """Delete the folders made after ``since``, once nothing reads them any more."""
    for scratch in _MADE[since:]:
        path, files = scratch._path()
        files.delete(path, True)
    del _MADE[since:]


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect, which gives heap and buffers that they no longer need back to the system.

    One task a core, so that each executor is likely to run one; in a local
    session the driver's JVM is the executor's.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    A lost executor costs only the tasks of the current step: what earlier
    steps wrote is read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def save(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """``df``, written and read again. What is ``small`` beside the input is written by at most
        :data:`TASKS` tasks a core, so that many small partitions don't become as many small files.
        """
        if small:
            df = df.coalesce(TASKS * self.spark.sparkContext.defaultParallelism)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        del df
        self.release()
        if not small and not re.match(r"local(\[|$)", self.spark.sparkContext.master):
            collect_garbage(self.spark)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner drop shuffle files of plans no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)

    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df``, small beside the input, saved as the only table that stays."""
        out = self.save(df, name, small=True)
        path, files = self._path()
        self.drop(*[n for n in (s.getPath().getName() for s in files.listStatus(path)) if n != name])
        return out

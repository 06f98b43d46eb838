"""Tables of a build kept by name, so that a later run can go on from any phase."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

PHASES = ("extract", "define", "synonyms", "senses", "cooccurrence", "graph")
log = logging.getLogger(__name__)


class Stages:
    """Writes a table ``phase/name`` below one folder and reads it again.

    Tables of phases before ``start`` (1 to 6) that an earlier run wrote whole
    are read instead of made; everything from ``start`` on is made anew.
    """

    def __init__(self, spark: SparkSession, path: str, start: int = 1):
        self.spark, self.path, self.start = spark, path.rstrip("/"), start

    def _whole(self, path: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if PHASES.index(name.split("/")[0]) + 1 < self.start and self._whole(path):
            log.info("%s is there", name)
        else:
            log.info("%s is made", name)
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

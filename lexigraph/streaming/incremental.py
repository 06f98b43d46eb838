"""New and changed source files folded into the occurrence table as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.concepts import name_occurrences
from ..operators.extraction import occurrences
from ..sources.files import optional


def source_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """``(file_path, text, modified)`` of files as they appear."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").option("maxFilesPerTrigger", per_trigger)
    return reader.schema("value string").load(root).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def keep_current(stream: DataFrame, table: str, checkpoint: str):
    """Upkeep of a table of occurrences by batch: rows of a file are replaced as a whole.

    Every batch writes a folder of its own, named by its number, so a batch that
    is run again after a failure overwrites its own output only.
    """

    def fold(batch: DataFrame, number: int) -> None:
        fresh = name_occurrences(occurrences(batch)).withColumn("batch", F.lit(number))
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.select("file_path").distinct().write.mode("overwrite").parquet(f"{table}-files/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Occurrences of every file's last batch."""
    schema = "file_path string, batch int"
    seen = optional(lambda: spark.read.parquet(f"{table}-files"), spark, schema)
    last = seen.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return spark.read.option("basePath", table).parquet(table).join(last, ["file_path", "batch"], "left_semi")

"""Answers and vectors kept between runs, as tables keyed by a text's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .files import optional


class CacheTable:
    """``(key, answer)`` in a Parquet folder that only grows."""

    def __init__(self, spark: SparkSession, path: str, value: str = "answer string"):
        self.spark, self.path, self.schema = spark, path, f"key string, {value}"

    def read(self) -> DataFrame:
        return optional(lambda: self.spark.read.parquet(self.path), self.spark, self.schema)

    def has(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Texts already answered."""
        return texts.join(self.read().select("key"), cache_key(F.col(text)) == F.col("key"), "left_semi")

    def misses(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return texts.join(self.read().select("key"), cache_key(F.col(text)) == F.col("key"), "left_anti")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def keep_only(self, keys: DataFrame, to: str) -> "CacheTable":
        """A copy at ``to`` with the named keys only; the old folder can then go."""
        self.read().join(keys.select("key").distinct(), "key", "left_semi").write.mode("overwrite").parquet(to)
        return CacheTable(self.spark, to, self.schema.split(", ", 1)[1])

"""Source files, JSON tables and what may be missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import glob_regex

EXCLUDED = ("**/tests/**", "**/vendor/**", "**/node_modules/**", "**/__pycache__/**")


def text_files(spark: SparkSession, root: str, include: tuple[str, ...] = ("*.py",), exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``(file_path, text)`` below ``root``, paths relative to it; names must match one of ``include`` and no relative path any of ``exclude``.

    Patterns are shell patterns in which ``*`` crosses slashes, so ``**/tests/**``
    keeps a ``tests`` folder directly below the root.
    """
    base = root.rstrip("/")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", include[0] if len(include) == 1 else "*")
    rows = reader.text(base, wholetext=True).select(F.regexp_replace(F.url_decode("_metadata.file_path"), "^.*?" + base.split("://")[-1].lstrip("/") + "/", "").alias("file_path"), F.col("value").alias("text"))
    name = F.element_at(F.split("file_path", "/"), -1)
    if len(include) > 1:
        rows = rows.where(name.rlike("|".join(glob_regex(p) for p in include)))
    return rows.where(~F.col("file_path").rlike("|".join(glob_regex(p) for p in exclude))) if exclude else rows


def plain_sources(spark: SparkSession, root: str, without: tuple[str, ...] = ("/tests/", "/vendor/", "/mocks/", "conftest.py")) -> DataFrame:
    """The simpler scan: ``*.py`` whose path contains none of some texts."""
    rows = text_files(spark, root, exclude=())
    for part in without:
        rows = rows.where(~F.contains(F.concat(F.lit("/"), "file_path"), F.lit(part)))
    return rows


def json_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file or folder, of one document or one a line, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def optional(read, spark: SparkSession, schema: StructType | str) -> DataFrame:
    """``read()``, or no rows where its path isn't there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def json_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return optional(lambda: json_table(spark, path, schema), spark, schema)


def cards_if_there(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, layer, responsibility, key_concepts)`` of a JSON file ``{"cards": [...]}``; no rows where there is none. A card without a layer is of ``utility``."""
    card = "file_path string, layer string, responsibility string, key_concepts array<string>"
    rows = json_if_there(spark, path, f"cards array<struct<{card.replace(' ', ': ').replace(',: ', ', ')}>>").select(F.inline("cards"))
    return rows.where("file_path is not null").select("file_path", F.coalesce("layer", F.lit("utility")).alias("layer"), F.coalesce("responsibility", F.lit("")).alias("responsibility"), F.coalesce("key_concepts", F.array().cast("array<string>")).alias("key_concepts"))


def instances(spark: SparkSession, path: str, repository: str | None = None) -> DataFrame:
    """Recorded benchmark instances, Parquet or JSON lines, of one repository."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    return rows.where(F.col("repo") == repository) if repository else rows

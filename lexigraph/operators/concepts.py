"""From identifier occurrences to concepts: filters, soft index, aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words


def name_occurrences(raw: DataFrame, blocked=None, min_length: int = 2) -> DataFrame:
    """Occurrences with their concept name, imports and nameless ones gone.

    An identifier of several parts that filtering leaves with one counts twice:
    under that part and, unless blocked itself, under its full name. Ids are
    hashes of where and what, so a rerun gives the same ones.
    """
    block = words.blocklist() if blocked is None else blocked
    parts = T.split_identifier(F.col("raw_identifier"))
    kept = T.filter_tokens(F.col("parts"), block, min_length=min_length)
    rows = raw.where("identifier_type <> 'import'").withColumn("parts", parts).withColumn("kept", kept)
    hit = F.exists("parts", lambda t: F.lower(t).isin(*block))
    full = F.lower("raw_identifier")
    compound = hit & (F.size("kept") == 1) & (F.size("parts") >= 2) & ~full.isin(*block)
    names = F.array_compact(F.array(F.nullif(F.array_join("kept", "_"), F.lit("")), F.when(compound, full)))
    rows = rows.withColumn("split_name", F.explode(names)).drop("parts", "kept")
    return rows.withColumn("occurrence_id", F.md5(F.concat_ws("|", "file_path", "line_number", "identifier_type", "raw_identifier", "ordinal", "split_name")))


def soft_index(raw: DataFrame, blocked=None, min_length: int = 2) -> DataFrame:
    """``(token, file_path)``: tokens kept out of the graph that still point at files.

    Three kinds: parts and full names of imports, blocked parts, and full names
    of identifiers that have a blocked part.
    """
    block = words.blocklist() if blocked is None else blocked
    rows = raw.select("file_path", F.lower("raw_identifier").alias("full"), F.transform(T.split_identifier(F.col("raw_identifier")), F.lower).alias("parts"), (F.col("identifier_type") == "import").alias("imported"))
    bad = F.filter("parts", lambda t: t.isin(*block))
    tokens = F.when(F.col("imported"), F.concat("parts", F.array("full"))).otherwise(F.when(F.size(bad) > 0, F.concat(bad, F.array("full"))).otherwise(F.slice(bad, 1, 0)))
    out = rows.select("file_path", F.explode(tokens).alias("token")).where(F.length("token") >= min_length)
    return out.select("token", "file_path").distinct()


def over_covered(occurrences: DataFrame, within: DataFrame | None = None, ratio: float = 0.5) -> DataFrame:
    """Names in more than ``ratio`` of the files, which are those of ``within`` where given."""
    total = (occurrences if within is None else within).agg(F.countDistinct("file_path").alias("total"))
    seen = occurrences.groupBy("split_name").agg(F.countDistinct("file_path").alias("files"))
    return seen.crossJoin(F.broadcast(total)).where(F.col("files") > ratio * F.col("total")).drop("total")  # total: one row


def covered(occurrences: DataFrame, files: DataFrame | None = None, ratio: float = 0.5) -> DataFrame:
    """Occurrences without those of names that are everywhere."""
    return occurrences.join(over_covered(occurrences, files, ratio).select("split_name"), "split_name", "left_anti")


def with_definitions(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """The last non-empty definition of each occurrence, by ``ord``."""
    last = definitions.where("definition <> ''").groupBy("occurrence_id").agg(F.max_by("definition", "ord").alias("definition"))
    return occurrences.drop("definition").join(last, "occurrence_id", "left")


def concepts(occurrences: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row per name: frequency, its terms, raw identifiers in order of first appearance."""
    first = occurrences.where("split_name <> ''").groupBy("split_name", "raw_identifier").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    out = first.groupBy("split_name").agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_list(F.struct("first", "raw_identifier"))).alias("raw"))
    return out.select(F.col("split_name").alias("canonical_name"), F.split("split_name", "_").alias("split_terms"), F.transform("raw", lambda r: r["raw_identifier"]).alias("all_raw_identifiers"), "frequency")


def longest_definition(occurrences: DataFrame) -> DataFrame:
    """``(canonical_name, definition)``: the longest, earliest on ties."""
    known = occurrences.where("definition <> ''")
    return known.groupBy(F.col("split_name").alias("canonical_name")).agg(F.min_by("definition", F.struct(-F.length("definition"), "ordinal", "definition")).alias("definition"))


def concept_text(concepts: DataFrame, definitions: DataFrame, raws: int = 3) -> DataFrame:
    """``(canonical_name, text)``: name, longest definition and some identifiers, for embedding."""
    rows = concepts.join(definitions, "canonical_name", "left")
    return rows.select("canonical_name", F.concat_ws(" | ", "canonical_name", F.nullif("definition", F.lit("")), F.array_join(F.slice("all_raw_identifiers", 1, raws), ", ")).alias("text"))


def seed_text(concepts: DataFrame, raws: int = 5) -> DataFrame:
    """``(concept, text)`` that issues are compared with: name, longest sense's definition or else the longest of all, terms, some identifiers."""
    said = F.nullif("definition", F.lit("")) if "definition" in concepts.columns else F.lit(None).cast("string")
    if "definition_clusters" in concepts.columns:
        senses = F.transform("definition_clusters", lambda s: F.struct((-F.length(s["canonical_definition"])).alias("n"), s["cluster"].alias("cluster"), s["canonical_definition"].alias("said")))
        said = F.coalesce(F.nullif(F.array_min(senses)["said"], F.lit("")), said)
    listed = lambda names: F.nullif(F.array_join(names, ", "), F.lit(""))
    return concepts.select(F.col("canonical_name").alias("concept"), F.concat_ws(" | ", "canonical_name", said, listed(F.col("split_terms")), listed(F.slice("all_raw_identifiers", 1, raws))).alias("text"))


def document_frequency(occurrences: DataFrame) -> DataFrame:
    """``(concept, df)``: files that hold a concept."""
    return occurrences.groupBy(F.col("split_name").alias("concept")).agg(F.countDistinct("file_path").alias("df"))

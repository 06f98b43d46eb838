"""The graph's tables put together from what the earlier steps found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .concepts import concepts, longest_definition, with_definitions

EDGE = ["src", "dst", "type", "weight", "track", "reason", "cooccurrence_count", "subdomain", "cross_subdomain"]


def synonym_edges(synonyms: DataFrame) -> DataFrame:
    return synonyms.select("src", "dst", "type", "weight", "track", "reason")


def cooccurrence_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("co-occurrence").alias("type"), "weight", "cooccurrence_count", F.col("dominant_subdomain").alias("subdomain"), "cross_subdomain")


def edges(*parts: DataFrame) -> DataFrame:
    """Union of edge tables with their kinds' columns; columns of other kinds are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for name, kind in zip(EDGE, ("string", "string", "string", "double", "string", "string", "bigint", "string", "boolean"), strict=True):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select(*EDGE)


def senses_by_concept(senses: DataFrame) -> DataFrame:
    """``(canonical_name, definition_clusters)`` from ``(concept, cluster, canonical_definition, occurrence_ids, distinctiveness)``."""
    item = F.struct("cluster", "canonical_definition", "occurrence_ids", "distinctiveness")
    return senses.where("concept <> ''").groupBy(F.col("concept").alias("canonical_name")).agg(F.array_sort(F.collect_list(item)).alias("definition_clusters"))


def graph(occurrences: DataFrame, edge_table: DataFrame, definitions: DataFrame | None = None, senses: DataFrame | None = None) -> dict[str, DataFrame]:
    """``concepts``, ``occurrences``, ``edges`` and ``concept_file``; edges that name unknown concepts are dropped."""
    occ = with_definitions(occurrences, definitions) if definitions is not None else occurrences
    if "definition" not in occ.columns:
        occ = occ.withColumn("definition", F.lit(None).cast("string"))
    found = concepts(occ).join(longest_definition(occ), "canonical_name", "left")
    if senses is not None:
        found = found.join(senses_by_concept(senses), "canonical_name", "left")
    names = found.select("canonical_name")
    known = edge_table.where("weight > 0").join(names.withColumnRenamed("canonical_name", "src"), "src", "left_semi").join(names.withColumnRenamed("canonical_name", "dst"), "dst", "left_semi")
    return {"concepts": found, "occurrences": occ, "edges": known.select(*EDGE), "concept_file": occ.select(F.col("split_name").alias("concept"), F.col("file_path").alias("file")).distinct()}

"""Files that issues ask to change: one plan for a whole batch of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, similar_across
from ..operators import bm25, graph, models, retrieval, routing
from ..operators.concepts import seed_text
from ..sources.lineage import cut
from .config import Settings


def issue_texts(issues: DataFrame) -> DataFrame:
    """``(issue_id, text)`` of ``(issue_id, title, body)``; short titles are enriched by the body's first line."""
    return issues.select("issue_id", F.concat_ws("\n", T.enriched_title(F.col("title"), F.col("body")), F.col("body")).alias("text"))


def chosen_occurrences(seeds: DataFrame, vectors: DataFrame, concepts: DataFrame, make=models.HashedEmbedder) -> DataFrame | None:
    """``(issue_id, concept, occurrence_id)``: of seeds with several senses the occurrences of the sense most like the issue; None if no senses are known."""
    if "definition_clusters" not in concepts.columns:
        return None
    each = concepts.select(F.col("canonical_name").alias("concept"), F.explode("definition_clusters").alias("s"))
    known = cut(models.embedded(each.select("concept", "s.cluster", F.col("s.canonical_definition").alias("text")), make))
    pairs = seeds.select("issue_id", "concept").join(known.select("concept", "cluster", "emb"), "concept").join(vectors.select("issue_id", F.col("emb").alias("asked")), "issue_id")
    best = retrieval.chosen_sense(seeds.select("issue_id", "concept"), pairs.select("issue_id", "concept", "cluster", cosine(F.col("emb"), F.col("asked")).alias("sim"))).where("cluster is not null")
    listed = each.select("concept", "s.cluster", F.explode("s.occurrence_ids").alias("occurrence_id"))
    return best.join(listed, ["concept", "cluster"]).select("issue_id", "concept", "occurrence_id")


def seeded(texts: DataFrame, tables: dict[str, DataFrame], settings: Settings | None = None, make=models.HashedEmbedder) -> tuple[DataFrame, DataFrame | None]:
    """(``(issue_id, concept, weight, reason)``, occurrences of chosen senses); without an embedder names and identifiers alone are looked up."""
    s = (settings or Settings()).retrieval
    if make is None:
        named = retrieval.fallback_seeds(texts, tables["concepts"]).withColumn("reason", F.lit("name"))
        return cut(retrieval.merged_seeds([named], s.seeds)), None
    asked = cut(models.embedded(texts.select("issue_id", "text"), make))
    known = cut(models.embedded(seed_text(tables["concepts"]), make))
    similar = similar_across(asked, known, s.floor, s.seeds)
    seeds = cut(retrieval.merged_seeds([retrieval.semantic_seeds(similar, s.semantic, s.floor, s.seeds), retrieval.token_seeds(texts, retrieval.token_index(tables["concepts"]), s.lexical)], s.seeds))
    return seeds, chosen_occurrences(seeds, asked, tables["concepts"], make)


def localize(issues: DataFrame, tables: dict[str, DataFrame], settings: Settings | None = None, cards: DataFrame | None = None, make=models.HashedEmbedder) -> DataFrame:
    """``(issue_id, rank, file_path, score, n_concepts, concepts, top_functions)``: seeds, senses, walk, file scores, boosts."""
    s = (settings or Settings()).retrieval
    texts = issue_texts(issues)
    seeds, locked = seeded(texts, tables, settings, make)
    start = seeds.select("issue_id", F.col("concept").alias("node"), "weight")
    reached = cut(graph.walk(start, tables["edges"], tables["concept_file"], s.hops, s.min_weight, ratio=s.max_file_ratio, by=("issue_id",)))
    files = tables["concept_file"].agg(F.countDistinct("file")).first()[0]
    ranked = retrieval.file_scores(reached.select("issue_id", F.col("node").alias("concept"), "weight"), tables["occurrences"], files, s.top_k, s.density, locked)
    orphans = retrieval.orphan_tokens(texts, tables["soft_index"], tables["concepts"], among=ranked)
    ranked = retrieval.boosted(ranked, retrieval.soft_boost(orphans, tables["soft_index"], files))
    if cards is not None:
        ranked = retrieval.architecture_boost(ranked, cards, texts)
    alone = texts.join(seeds.select("issue_id").distinct(), "issue_id", "left_anti")
    rest = retrieval.soft_ranking(alone, tables["soft_index"], tables["concepts"], files, s.top_k)
    return ranked.unionByName(rest, allowMissingColumns=True)


def hybrid(issues: DataFrame, tables: dict[str, DataFrame], files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Graph and lexical rankings fused by each issue's kind."""
    k = (settings or Settings()).retrieval.top_k
    texts = issue_texts(issues)
    lexical = bm25.topk(files, texts, 50, key="file_path", query="issue_id")
    return routing.weighted_fusion(localize(issues, tables, settings), lexical, routing.classify(texts, F.col("text")), k)

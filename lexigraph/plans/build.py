"""From source files to the graph: extract, define, relate, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import assembly, concepts, cooccurrence, extraction, models, ranking, senses, synonyms
from ..sources.cache import CacheTable
from ..sources.lineage import cut
from .config import Settings

Keep = Callable[[DataFrame, str], DataFrame]


def build(files: DataFrame, settings: Settings | None = None, definitions: bool = True, keep: Keep = cut, cache: str | None = None, sample: tuple[int, int] | None = None, writer=models.TemplateWriter, embedder=models.HashedEmbedder) -> dict[str, DataFrame]:
    """Tables of the graph for ``files(file_path, text)``; also ``soft_index``.

    ``keep`` holds on to tables that several later steps read, by a name; the
    default writes and rereads them, so plans stay small and survive lost
    executors, and :class:`lexigraph.plans.stages.Stages` also lets a later run go
    on from any phase. Answers and vectors go through the tables below ``cache``,
    where given. With ``sample`` (least, most) only names of ``least`` occurrences
    or more are defined, by ``most`` of each.
    """
    s = settings or Settings()
    r, spark = s.relations, files.sparkSession
    answers = CacheTable(spark, f"{cache}/answers") if cache else None
    vectors_of = lambda texts: models.remembered_vectors(texts, CacheTable(spark, f"{cache}/vectors", "emb array<double>") if cache else None, embedder)
    ask = lambda prompts: models.answered(prompts, writer)

    raw = keep(extraction.occurrences(files, s.extraction.context_lines), "extract/raw")
    occ = keep(concepts.covered(concepts.name_occurrences(raw, min_length=s.extraction.min_length), raw, s.extraction.max_file_ratio), "extract/named")

    if definitions:
        asked = ranking.stratified(occ, "split_name", "occurrence_id", *sample) if sample else occ
        said = models.remembered(models.definition_prompts(asked).select("occurrence_id", "prompt"), answers, ask)
        said = said.where("answer <> ''").groupBy("occurrence_id").agg(F.min("answer").alias("definition"))
        occ = occ.join(said, "occurrence_id", "left")
    else:
        occ = occ.withColumn("definition", F.lit(None).cast("string"))
    occ = keep(occ, "define/occurrences")

    found = keep(concepts.concepts(occ), "synonyms/concepts")
    defined = concepts.longest_definition(occ)
    texts = keep(numbered(concepts.concept_text(found, defined), "canonical_name"), "synonyms/texts")
    vectors = keep(vectors_of(texts), "synonyms/vectors")
    pairs = keep(synonyms.tracks(synonyms.candidates(vectors, r.similarity, r.per_concept), r.naming, r.judge_low, r.judge_high), "synonyms/pairs")
    names = texts.select("id", "canonical_name")
    by_name = pairs.join(names.select(F.col("id").alias("i"), F.col("canonical_name").alias("a")), "i").join(names.select(F.col("id").alias("j"), F.col("canonical_name").alias("b")), "j")
    questions = models.judge_prompts(by_name.where("track = 'semantic'"), found.join(defined, "canonical_name", "left"))
    judged = models.verdicts(models.remembered(questions, answers, ask))
    same = synonyms.edges(pairs, judged)
    same = same.withColumnsRenamed({"src": "i", "dst": "j"}).join(names.select(F.col("id").alias("i"), F.col("canonical_name").alias("src")), "i").join(names.select(F.col("id").alias("j"), F.col("canonical_name").alias("dst")), "j")
    same = keep(same, "synonyms/edges")

    meanings = None
    if definitions:
        worth = senses.worth_checking(occ, r.sense_occurrences, r.sense_files).select("split_name")
        defs = occ.join(worth, "split_name", "left_semi").where("definition is not null").select(F.col("split_name").alias("name"), "occurrence_id", F.col("definition").alias("text"), F.xxhash64("occurrence_id").alias("id"))
        embedded = keep(vectors_of(defs), "senses/vectors")
        label = keep(senses.clusters(embedded, r.sense_eps), "senses/labels")
        near = senses.representatives(embedded, label)
        members = label.join(defs.select("id", "occurrence_id"), "id").groupBy("name", "cluster").agg(F.array_sort(F.collect_list("occurrence_id")).alias("occurrence_ids"))
        meanings = near.join(members, ["name", "cluster"]).join(defs.select(F.col("id").alias("representative"), F.col("text").alias("canonical_definition")), "representative")
        meanings = meanings.withColumn("of", F.count("*").over(W.partitionBy("name"))).where("of > 1").select(F.col("name").alias("concept"), "cluster", "canonical_definition", "occurrence_ids", "distinctiveness")

    together = cooccurrence.cooccurrence(cooccurrence.contexts(occ), r.min_count, r.normalization, r.threshold, cross_factor=r.cross_factor)
    edges = keep(assembly.edges(assembly.synonym_edges(same), assembly.cooccurrence_edges(together)), "cooccurrence/edges")
    out = assembly.graph(occ, edges, senses=meanings)
    out["soft_index"] = concepts.soft_index(raw)
    return {name: keep(table, f"graph/{name}") for name, table in out.items()}


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with an ``id`` that rises with ``by``, given range by range; keep the result before it is read twice."""
    return rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("id", F.monotonically_increasing_id())

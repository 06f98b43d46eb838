"""Command line: ``spark-submit -m`` or ``python -m lexigraph COMMAND ...``.

build ROOT OUT        source files below ROOT to graph tables in OUT; --start-from goes on from a phase
export OUT PATH       the graph as one .json or .gexf file
localize OUT ISSUES   files for issues of a JSON table (issue_id, title, body)
evaluate OUT TRUTH    hit rate and reciprocal rank on (issue_id, title, body, changed_files)
card OUT NAME         one concept
path OUT A B          shortest path, explained
impact OUT FILE...    files that changes may affect
report OUT            counts, hubs and strongest edges
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log
from .operators import evaluation, graph, reports
from .operators.models import HashedEmbedder
from .plans.build import build
from .plans.config import embedder, load, writer
from .plans.localize import localize
from .plans.stages import Stages
from .sources.files import cards_if_there, json_table, text_files
from .sources.lineage import cut
from .sources.sinks import issue_dump, load_graph, save_gexf, save_graph, save_json

ISSUE = "issue_id bigint, title string, body string"


def _tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return load_graph(spark, out) | {"soft_index": spark.read.parquet(f"{out}/soft_index")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    parser = argparse.ArgumentParser(prog="lexigraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["build", "export", "localize", "evaluate", "card", "path", "impact", "report"])
    parser.add_argument("args", nargs="+")
    parser.add_argument("--config")
    parser.add_argument("--cards", help="module cards, a JSON file")
    parser.add_argument("--cache", help="folder of answers and vectors")
    parser.add_argument("--sample", type=int, nargs=2, metavar=("LEAST", "MOST"))
    parser.add_argument("--skip-definitions", action="store_true")
    parser.add_argument("--start-from", type=int, default=1, choices=range(1, 7))
    parser.add_argument("--report", help="Markdown file for an evaluation")
    parser.add_argument("--log-level", default="WARNING")
    parser.add_argument("--log-file")
    parser.add_argument("--top-k", type=int)
    parser.add_argument("--radius", type=int, default=1)
    parser.add_argument("--max-hops", type=int, default=4)
    said = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexigraph").getOrCreate()
    log.setup(said.log_level, said.log_file)
    settings, out = load(said.config), said.args[0]
    if said.command == "build":
        steps = Stages(spark, f"{said.args[1]}/stages", said.start_from)
        made = build(text_files(spark, out), settings, not said.skip_definitions, steps, said.cache or settings.models.cache or None, tuple(said.sample) if said.sample else None, writer(settings), embedder(settings) or HashedEmbedder)
        save_graph(made, said.args[1])
        return None
    tables = _tables(spark, out)
    if said.command == "export":
        (save_gexf if said.args[1].endswith(".gexf") else save_json)(tables, said.args[1])
        return None
    k, make = said.top_k or settings.retrieval.top_k, embedder(settings)
    cards = cards_if_there(spark, said.cards) if said.cards else None
    match said.command:
        case "localize":
            result = localize(json_table(spark, said.args[1], ISSUE), tables, settings, cards, make).where(F.col("rank") <= k)
        case "evaluate":
            truth = json_table(spark, said.args[1], ISSUE + ", changed_files array<string>")
            told, right = cut(localize(truth, tables, settings, cards, make)), truth.select("issue_id", F.explode("changed_files").alias("file_path"))
            hits = evaluation.first_hits(told, right, suffix=True)
            result = evaluation.summary(hits, k)
            if said.report:
                Path(said.report).write_text(reports.navigation(result, issue_dump(told, right, hits)), encoding="utf-8")
        case "card":
            files = tables["concept_file"].agg(F.countDistinct("file")).first()[0]
            result = graph.concept_cards(tables["concepts"], tables["edges"], tables["concept_file"], files).where(F.col("concept") == said.args[1])
        case "path":
            result = graph.explained(graph.shortest_path(tables["edges"], *said.args[1:3], hops=said.max_hops), tables["edges"])
        case "impact":
            result = graph.impact_report(spark.createDataFrame([(f,) for f in said.args[1:]], "changed string"), tables["edges"], tables["concept_file"], said.radius)
        case "report":
            reports.totals(tables["concepts"], tables["edges"]).show(truncate=60)
            reports.top_concepts(tables["concepts"], tables["concept_file"]).show(30, truncate=60)
            if "definition_clusters" in tables["concepts"].columns:
                reports.most_senses(tables["concepts"]).show(truncate=60)
            reports.edge_counts(tables["edges"]).show(truncate=60)
            reports.strongest(tables["edges"], "synonym").show(truncate=60)
            reports.strongest(tables["edges"], "co-occurrence").show(truncate=60)
            result = reports.hubs(tables["edges"])
    result.show(k * 10, truncate=60)
    return result


if __name__ == "__main__":
    main()

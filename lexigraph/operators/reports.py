"""Statistics and fixed reports over concepts and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .graph import undirected


def totals(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: concepts, edges, occurrences, and concepts of several senses."""
    senses = F.size("definition_clusters") if "definition_clusters" in concepts.columns else F.lit(0)
    mine = concepts.agg(F.count("*").alias("total_concepts"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_occurrences"), F.count(F.when(senses > 1, 1)).alias("polysemous_concepts"))
    return mine.crossJoin(edges.agg(F.count("*").alias("total_relationships")))  # one row each


def top_concepts(concepts: DataFrame, concept_file: DataFrame, k: int = 30, raws: int = 5) -> DataFrame:
    """The most frequent concepts with their number of files and first identifiers."""
    first = most_frequent(concepts, k).select("canonical_name", "frequency", F.slice("all_raw_identifiers", 1, raws).alias("raw_identifiers"))
    files = concept_file.groupBy(F.col("concept").alias("canonical_name")).agg(F.countDistinct("file").alias("num_files"))
    return first.join(files, "canonical_name", "left").withColumn("num_files", F.coalesce("num_files", F.lit(0)))


def most_senses(concepts: DataFrame, k: int = 15, cut: int = 100) -> DataFrame:
    """Concepts of several senses, those of most first, with the senses' definitions."""
    rows = concepts.select("canonical_name", F.size("definition_clusters").alias("num_meanings"), F.transform("definition_clusters", lambda s: F.substring(s["canonical_definition"], 1, cut)).alias("meanings"))
    return rows.where("num_meanings > 1").orderBy(F.desc("num_meanings"), "canonical_name").limit(k)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


def type_pivot(edges: DataFrame, types=("synonym", "co-occurrence", "polysemy")) -> DataFrame:
    """One row: edges in all, and of each kind."""
    return edges.agg(F.count("*").alias("total"), *[F.sum(F.when(F.col("type") == t, 1).otherwise(0)).cast("bigint").alias(t.replace("-", "_")) for t in types])


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``, both ends counted."""
    return undirected(edges, distinct=False).groupBy("node").agg(F.count("*").alias("degree"))


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest, average, upper median (of the falling order) and isolated nodes; the median needs only the histogram of degrees."""
    each = nodes.select("node").join(degrees(edges), "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    seen = each.where("degree > 0")
    counts = seen.groupBy("degree").agg(F.count("*").alias("n"))
    order = W.orderBy(F.desc("degree"))
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy()))
    stats = placed.agg(
        F.max("degree").alias("max_degree"),
        F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("avg_degree"),
        F.max(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("degree"))).alias("median_degree"),
    )
    return stats.crossJoin(each.agg(F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).cast("bigint").alias("isolated")))


def hubs(edges: DataFrame, k: int = 20) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def strongest(edges: DataFrame, kind: str, k: int = 20, where: str = "true") -> DataFrame:
    """The heaviest edges of a kind."""
    return edges.where((F.col("type") == kind) & F.expr(where)).orderBy(F.desc("weight"), "src", "dst").limit(k)


def most_frequent(concepts: DataFrame, k: int = 15) -> DataFrame:
    return concepts.orderBy(F.desc("frequency"), "canonical_name").limit(k)


def ego(edges: DataFrame, name: str, k: int = 20) -> DataFrame:
    """A node's heaviest edges, either way, with their track or subdomain."""
    rows = undirected(edges, distinct=False).where(F.col("node") == name)
    return rows.select("nbr", "type", "weight", F.coalesce("track", "subdomain", F.lit("")).alias("detail")).orderBy(F.desc("weight"), "nbr", "type").limit(k)


def search(concepts: DataFrame, part: str) -> DataFrame:
    """Concepts whose name or identifiers contain a text, case ignored."""
    low = part.lower()
    return concepts.where(F.contains(F.lower("canonical_name"), F.lit(low)) | F.exists("all_raw_identifiers", lambda r: F.contains(F.lower(r), F.lit(low))))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, those with and without an edge, and the isolated share."""
    ends = undirected(edges).select("node").distinct().withColumn("linked", F.lit(1))
    rows = nodes.select("node").distinct().join(ends, "node", "left")
    return rows.agg(F.count("*").alias("nodes"), F.sum(F.coalesce("linked", F.lit(0))).cast("bigint").alias("linked"), F.round(F.avg(F.when(F.col("linked").isNull(), 1.0).otherwise(0.0)), 6).alias("isolated_share"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def markdown(rows: DataFrame, title: str, k: int = 30) -> str:
    """A report of the first ``k`` rows, which is all that leaves the cluster."""
    shown, names = rows.limit(k).collect(), rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(v)[:60] for v in r) + " |" for r in shown]) + "\n"


def navigation(summary: DataFrame, issues: DataFrame, title: str = "Navigation report", k: int = 30) -> str:
    """A report of an evaluation: its one-row ``summary``, then the first ``k`` issues of :func:`lexigraph.sources.sinks.issue_dump`."""
    row, total = summary.first().asDict(), issues.count()
    shown = issues.orderBy(issues.columns[0]).limit(k).collect()
    listed = lambda paths: (", ".join((paths or [])[:3]) or "(none)")[:60]
    lines = [f"# {title}", "", "## Summary", "", "| Metric | Value |", "|---|---|", *(f"| {name} | {value} |" for name, value in row.items())]
    lines += ["", "## Issues", "", "| # | Issue | Right files | Predicted files | Rank |", "|---|---|---|---|---|"]
    lines += [f"| {n} | {r[0]} | {listed(r['gt_files'])} | {listed(r['predicted_files'])} | {r['file_rank'] or '-'} |" for n, r in enumerate(shown, 1)]
    return "\n".join(lines + ([f"| ... | | | ({total} in all) | |"] if total > len(shown) else [])) + "\n"

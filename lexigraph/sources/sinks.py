"""Writers of the graph and its reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import undirected

log = logging.getLogger(__name__)


def save_graph(graph: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table each."""
    for name, table in graph.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_graph(spark, path: str) -> dict[str, DataFrame]:
    """The tables again; edges without ends or weight are dropped."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in ("concepts", "occurrences", "edges", "concept_file")}
    out["edges"] = out["edges"].where("src <> '' and dst <> '' and weight > 0")
    return out


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def _whole(spark, sections: list[tuple[str, DataFrame | None, str]], path: str) -> None:
    """One file made of ``(before, lines, between)`` sections, the last of no lines.

    The executors write the lines of each section, every line after ``between``;
    the driver then copies their bytes into the file in turn, holding one buffer.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    parts, target = f"{path}.parts", hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    for n, (_, lines, between) in enumerate(sections):
        if lines is not None:
            lines.select(F.concat(F.lit(between), "line")).write.mode("overwrite").text(f"{parts}/{n}")
    out = files.create(target, True)
    try:
        for n, (before, lines, between) in enumerate(sections):
            out.write(bytearray(before.encode()))
            skip = len(between.encode())
            if lines is None:
                continue
            for status in sorted(files.listStatus(hadoop.fs.Path(f"{parts}/{n}")), key=lambda s: s.getPath().getName()):
                if status.getPath().getName().startswith("part-") and status.getLen():
                    part = files.open(status.getPath())
                    try:
                        part.seek(skip)  # only the first line of a section has nothing before it
                        skip = 0
                        hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                    finally:
                        part.close()
    finally:
        out.close()
    files.delete(hadoop.fs.Path(parts), True)


def save_json(graph: dict[str, DataFrame], path: str) -> None:
    """One JSON document of the graph: lists ``concepts``, ``occurrences`` and ``relationships``, occurrences by their concept's name."""
    line = lambda name: graph[name].select(F.to_json(F.struct("*")).alias("line"))
    _whole(graph["concepts"].sparkSession, [('{"concepts": [\n', line("concepts"), ","), ('], "occurrences": [\n', line("occurrences"), ","), ('], "relationships": [\n', line("edges"), ","), ("]}\n", None, "")], path)


def gexf_nodes(concepts: DataFrame) -> DataFrame:
    """Attributes of the exchange format's nodes."""
    senses = F.size("definition_clusters") > 1 if "definition_clusters" in concepts.columns else F.lit(False)
    return concepts.select(F.col("canonical_name").alias("id"), F.col("canonical_name").alias("label"), "frequency", F.col("frequency").alias("num_occurrences"), F.size("all_raw_identifiers").alias("num_raw_identifiers"), F.coalesce(senses, F.lit(False)).alias("has_polysemy"))


def gexf_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges; of parallel ones that of the last kind stays, synonyms coming first, and the heaviest of that kind."""
    kind = F.when(F.col("type") == "synonym", 0).when(F.col("type") == "co-occurrence", 1).otherwise(2)
    pair = [F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")]
    return edges.select(*pair, "type", "weight").groupBy("source", "target").agg(F.max_by(F.struct("type", "weight"), F.struct(kind, "weight", "type")).alias("e")).select("source", "target", "e.*")


def save_gexf(graph: dict[str, DataFrame], path: str) -> None:
    """One exchange-format document of the graph, undirected."""
    def safe(c):
        out = F.regexp_replace(F.col(c).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(plain), F.lit(coded))
        return F.coalesce(out, F.lit(""))

    def values(names):
        return F.concat(F.lit("<attvalues>"), *[p for n, c in enumerate(names) for p in (F.lit(f'<attvalue for="{n}" value="'), safe(c), F.lit('"/>'))], F.lit("</attvalues>"))

    def declared(of, columns):
        return f'<attributes class="{of}" mode="static">' + "".join(f'<attribute id="{n}" title="{c}" type="{t}"/>' for n, (c, t) in enumerate(columns.items())) + "</attributes>\n"

    mine = {"frequency": "long", "num_occurrences": "long", "num_raw_identifiers": "integer", "has_polysemy": "boolean"}
    nodes = gexf_nodes(graph["concepts"]).select(F.concat(F.lit('<node id="'), safe("id"), F.lit('" label="'), safe("label"), F.lit('">'), values(mine), F.lit("</node>")).alias("line"))
    edges = gexf_edges(graph["edges"]).select(F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('" weight="'), safe("weight"), F.lit('">'), values(["type"]), F.lit("</edge>")).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="undirected" mode="static">\n'
    _whole(graph["concepts"].sparkSession, [(head + declared("node", mine) + declared("edge", {"type": "string"}) + "<nodes>\n", nodes, ""), ("</nodes>\n<edges>\n", edges, ""), ("</edges>\n</graph>\n</gexf>\n", None, "")], path)


#: What a graph server is told before the first rows; a statement that it doesn't know is skipped.
PREPARE = (
    "CREATE CONSTRAINT IF NOT EXISTS FOR (c:Concept) REQUIRE c.name IS UNIQUE",
    "CREATE INDEX IF NOT EXISTS FOR (c:Concept) ON (c.frequency)",
    "CREATE INDEX IF NOT EXISTS FOR ()-[e:SYNONYM]-() ON (e.weight)",
    "CREATE INDEX IF NOT EXISTS FOR ()-[e:CO_OCCURRENCE]-() ON (e.weight)",
)


def _prepared(connect, clear: bool) -> None:
    server = connect()
    try:
        if clear:
            server.run("MATCH (n) DETACH DELETE n", [])
        for statement in PREPARE:
            try:
                server.run(statement, [])
            except Exception as e:
                log.warning("skipped %s: %s", statement, e)
    finally:
        server.close()


def _counted(connect) -> dict:
    server = connect()
    try:
        return {"nodes": server.run("MATCH (n:Concept) RETURN count(n) AS n", []), "edges": server.run("MATCH ()-[e]->() RETURN count(e) AS n", [])}
    finally:
        server.close()


def to_graph_database(graph: dict[str, DataFrame], connect, batch: int = 500, raws: int = 20, reason: int = 240, clear: bool = False) -> dict:
    """Load a property-graph server in batches from every partition.

    ``connect()`` gives an object with ``run(statement, rows)`` and ``close()``.
    Statements merge, so a task that runs twice leaves one copy. Constraints and
    indexes come first, after emptying the server with ``clear``; returned is
    what the server answers when asked for the numbers of nodes and edges.
    """
    _prepared(connect, clear)
    nodes = graph["concepts"].select("canonical_name", "frequency", F.slice("all_raw_identifiers", 1, raws).alias("raw_identifiers"))
    edges = graph["edges"].select("src", "dst", F.upper(F.replace("type", F.lit("-"), F.lit("_"))).alias("kind"), "weight", F.coalesce("track", F.lit("")).alias("track"), F.substring(F.coalesce("reason", F.lit("")), 1, reason).alias("reason"), F.coalesce("subdomain", F.lit("")).alias("subdomain"))

    def sender(statement):
        def send(rows):
            server, some = connect(), []
            try:
                for row in rows:
                    some.append(row.asDict(True))
                    if len(some) == batch:
                        server.run(statement(some), some)
                        some = []
                if some:
                    server.run(statement(some), some)
            finally:
                server.close()

        return send

    nodes.foreachPartition(sender(lambda _: "UNWIND $rows AS r MERGE (c:Concept {name: r.canonical_name}) SET c += r"))
    for (kind,) in edges.select("kind").distinct().collect():  # a handful of kinds
        edges.where(F.col("kind") == kind).foreachPartition(sender(lambda _, kind=kind: f"UNWIND $rows AS r MATCH (a:Concept {{name: r.src}}), (b:Concept {{name: r.dst}}) MERGE (a)-[e:{kind}]->(b) SET e += r"))
    return _counted(connect)


def adjacency(edges: DataFrame) -> DataFrame:
    """``(node, neighbours)`` for in-memory graph libraries."""
    return undirected(edges).groupBy("node").agg(F.array_sort(F.collect_list("nbr")).alias("neighbours"))


def issue_dump(ranked: DataFrame, truth: DataFrame, hits: DataFrame, key: str = "issue_id") -> DataFrame:
    """Per issue what was predicted, what was right and where it ranked."""
    told = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("predicted_files"))
    right = truth.groupBy(key).agg(F.array_sort(F.collect_set("file_path")).alias("gt_files"))
    return right.join(told, key, "left").join(hits.select(key, F.col("rank").alias("file_rank")), key, "left")

"""The graph's query functions, over ``edges(src, dst, type, weight, ...)`` and ``concept_file(concept, file)``.

Loops run over hops only, at most a handful; every hop is a join and an
aggregate over all sources at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.lineage import cut
from .ranking import top


def valid_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src <> '' and dst <> '' and weight > 0")


def undirected(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """``(node, nbr)`` both ways; with ``distinct=False`` every typed edge stays, with its other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), *rest)
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), *rest)
    both = there.unionByName(back)
    return both.select("node", "nbr").distinct() if distinct else both


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    return undirected(edges).where(F.col("node") == name).select(F.col("nbr").alias("neighbour"))


def files_of(concept_file: DataFrame, name: str) -> DataFrame:
    return concept_file.where(F.col("concept") == name).select("file").distinct()


def concepts_in_file(concept_file: DataFrame, path: str) -> DataFrame:
    """Concepts of the file that a path names: exact, else the file with the longest common suffix, else the first."""
    file = F.col("file")
    fits = (file == path) | F.endswith(file, F.lit(path)) | F.endswith(F.lit(path), file) | F.contains(file, F.lit(path))
    best = concept_file.select("file").distinct().where(fits).orderBy(F.desc(file == path), F.desc(F.length("file")), "file").limit(1)
    return concept_file.join(F.broadcast(best), "file", "left_semi").select("file", "concept").distinct()  # best: one row


def exists(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(name, known)``: whether there is a concept of that name."""
    known = concepts.select(F.col("canonical_name").alias("name")).distinct().withColumn("known", F.lit(True))
    return names.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


def idf_of(names: DataFrame, concept_file: DataFrame, unknown: float = 1.0) -> DataFrame:
    """``(name, idf)`` by the files that hold a concept; ``unknown`` for names in none."""
    total = concept_file.agg(F.countDistinct("file").alias("total"))
    df = concept_file.groupBy(F.col("concept").alias("name")).agg(F.countDistinct("file").alias("df")).crossJoin(F.broadcast(total))  # total: one row
    return names.select("name").distinct().join(df, "name", "left").select("name", F.coalesce(T.idf(F.col("total"), F.col("df")), F.lit(unknown)).alias("idf"))


def bfs(seeds: DataFrame, edges: DataFrame, hops: int = 3, decay: float = 0.5, least: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., node, weight)``: the largest seed weight times decay to the number of hops; ``seeds(by..., node, weight)``."""
    near = undirected(edges)
    keys = [*by, "node"]
    reached = seeds.groupBy(*keys).agg(F.max("weight").alias("weight"))
    front = reached
    for _ in range(hops):
        front = front.join(near, "node").select(*by, F.col("nbr").alias("node"), (F.col("weight") * decay).alias("weight")).where(F.col("weight") >= least)
        front = front.groupBy(*keys).agg(F.max("weight").alias("weight"))
        reached = reached.unionByName(front)
    return reached.groupBy(*keys).agg(F.max("weight").alias("weight"))


def closure(seeds: DataFrame, edges: DataFrame, radius: int = 1) -> DataFrame:
    """``(node)`` within ``radius`` hops of the seeds."""
    near, out = undirected(edges), seeds.select("node").distinct()
    front = out
    for _ in range(radius):
        front = front.join(near, "node").select(F.col("nbr").alias("node")).distinct()
        out = out.unionByName(front).distinct()
    return out


def subgraph(seeds: DataFrame, edges: DataFrame, radius: int = 1) -> DataFrame:
    """Edges with both ends within ``radius`` of the seeds, each (src, dst, type) once."""
    nodes = closure(seeds, edges, radius)
    kept = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def shortest_path(edges: DataFrame, source: str, target: str, hops: int = 4) -> DataFrame:
    """One row ``(source, target, hops, path)``, or none: the shortest path, smallest in order of names among equals.

    Every hop keeps one path per node, the smallest, which any extension of
    equal length can only keep smallest.
    """
    near = undirected(edges)
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    if source == target:
        return front.select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(0).alias("hops"), "path")
    layers = []
    for h in range(1, hops + 1):
        grown = front.join(near, "node").where(~F.array_contains("path", F.col("nbr"))).select(F.col("nbr").alias("node"), F.concat("path", F.array("nbr")).alias("path"))
        front = grown.groupBy("node").agg(F.min("path").alias("path"))
        layers.append(front.where(F.col("node") == target).select(F.lit(h).alias("hops"), "path"))
    found = reduce(DataFrame.unionByName, layers)
    best = found.orderBy("hops", "path").limit(1)
    return best.select(F.lit(source).alias("source"), F.lit(target).alias("target"), "hops", "path")


def shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """``(source, target, hops, path)`` of all pairs ``(source, target)`` at once, as :func:`shortest_path` finds each; pairs too far apart are left out.

    The search starts from the side of fewer different ends and grows paths at
    their other end. Every hop keeps one path per start and node, the smallest,
    which any extension on either side can only keep smallest; nodes reached
    before don't go on, and of the last hop only what is asked stays.
    """
    near, asked = undirected(edges), cut(pairs.select("source", "target").distinct())
    ends = asked.agg(F.countDistinct("source").alias("source"), F.countDistinct("target").alias("target")).first()
    start, end = ("target", "source") if ends["target"] < ends["source"] else ("source", "target")
    front = asked.select(start).distinct().select(start, F.col(start).alias("node"), F.array(start).alias("path"))
    seen = front.select(start, "node", F.lit(0).alias("hops"), "path")
    for h in range(1, hops + 1):
        path = F.concat("path", F.array("nbr")) if start == "source" else F.concat(F.array("nbr"), "path")
        grown = front.join(near, "node").select(start, F.col("nbr").alias("node"), path.alias("path"))
        if h == hops:
            grown = grown.join(asked.withColumnRenamed(end, "node"), [start, "node"], "left_semi")
        front = grown.groupBy(start, "node").agg(F.min("path").alias("path")).join(seen.select(start, "node"), [start, "node"], "left_anti")
        front = cut(front)
        seen = seen.unionByName(front.select(start, "node", F.lit(h).alias("hops"), "path"))
    return asked.join(seen.withColumnRenamed("node", end), ["source", "target"]).select("source", "target", "hops", "path")


def explained(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of paths: ``(source, target, step, src, dst, type, weight)`` by the strongest edge of each step."""
    steps = path.select("source", "target", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("u"), F.slice("path", F.lit(2), F.size("path") - 1).alias("v"))).alias("step", "e"))
    both = undirected(edges, distinct=False).groupBy("node", "nbr").agg(F.max_by(F.struct("type", "weight"), F.struct("weight", "type")).alias("w"))
    steps = steps.select("source", "target", "step", F.col("e.u").alias("node"), F.col("e.v").alias("nbr"))
    return steps.join(both, ["node", "nbr"]).select("source", "target", "step", F.col("node").alias("src"), F.col("nbr").alias("dst"), "w.type", "w.weight")


def impact(files: DataFrame, edges: DataFrame, concept_file: DataFrame, radius: int = 1) -> DataFrame:
    """Files affected by changes: ``(changed, file, direct, shared)``.

    A changed file's concepts spread ``radius`` hops; a file holding any of what
    is reached is affected, directly if it shares one of the file's own concepts.
    ``shared`` counts the concepts it holds of those reached. A file affected only
    indirectly is left out if its path holds the changed one, or is held by it.
    """
    local = files.select("changed").join(concept_file, F.col("changed") == F.col("file")).select("changed", F.col("concept").alias("node"), F.lit(0).alias("d")).distinct()
    near, reach, front = undirected(edges), local, local
    for h in range(1, radius + 1):
        front = front.join(near, "node").select("changed", F.col("nbr").alias("node"), F.lit(h).alias("d")).distinct()
        reach = reach.unionByName(front)
    reach = reach.groupBy("changed", "node").agg(F.min("d").alias("d"))
    held = reach.join(concept_file.withColumnRenamed("concept", "node"), "node").where("file <> changed")
    hit = held.groupBy("changed", "file").agg(F.bool_or(F.col("d") == 0).alias("direct"), F.countDistinct("node").alias("shared"))
    return hit.where(F.col("direct") | ~(F.contains("file", F.col("changed")) | F.contains(F.col("changed"), F.col("file"))))


def impact_report(files: DataFrame, edges: DataFrame, concept_file: DataFrame, radius: int = 1, most: int = 20) -> DataFrame:
    """The files most affected by a set of changes, the changed ones left out."""
    hit = impact(files, edges, concept_file, radius).groupBy("file").agg(F.bool_or("direct").alias("direct"), F.max("shared").alias("shared"))
    hit = hit.join(files.select(F.col("changed").alias("file")), "file", "left_anti")
    return hit.orderBy(F.desc("direct"), F.desc("shared"), "file").limit(most)


def concept_cards(concepts: DataFrame, edges: DataFrame, concept_file: DataFrame, files: int, most: int = 15) -> DataFrame:
    """Per concept its definition, frequency, files, neighbours and idf."""
    held = concept_file.distinct()
    # a hub's files are cut to the first before any are gathered
    first = top(held, ["concept"], ["file"], most, "r").groupBy("concept").agg(F.array_sort(F.collect_list("file")).alias("files"))
    held = held.groupBy("concept").agg(F.count("*").alias("file_count")).join(first, "concept")
    near = undirected(edges).join(concepts.select(F.col("canonical_name").alias("nbr"), F.substring("definition", 1, 80).alias("nbr_definition")), "nbr", "left")
    near = near.groupBy(F.col("node").alias("concept")).agg(F.array_sort(F.collect_list(F.struct("nbr", "nbr_definition"))).alias("neighbours"))
    out = concepts.withColumnRenamed("canonical_name", "concept").join(held, "concept", "left").join(near, "concept", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("file_count", F.coalesce("file_count", F.lit(0))).withColumn("files", F.coalesce("files", empty))
    return out.withColumn("idf", F.log(1.0 + F.lit(float(files)) / F.greatest("file_count", F.lit(1))))


def walk(seeds: DataFrame, edges: DataFrame, concept_file: DataFrame | None = None, hops: int = 3, least: float = 0.01, factors: dict | None = None, ratio: float = 0.30, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights of the strongest walk from any seed: ``(by..., node, weight, hop, via, edge_type, seed, path)``.

    ``path`` is the walk itself, from its seed: ``(concept, edge_type)`` of every
    node, with the kind of edge that led there.

    A step multiplies by the edge's weight and its kind's factor. The gain never
    rises along a walk, so per hop only the best walk into a node can go on to be
    best, and one row per node and hop is enough. Nodes in more than ``ratio`` of
    the files are dead ends: not entered, not left; as seeds they keep their own weight.
    """
    factors = {"naming_variant": 1.0, "semantic": 0.2, "co-occurrence": 0.5, "callgraph": 0.2} | (factors or {})
    kind = F.when(F.col("type") == "synonym", F.coalesce("track", F.lit("naming_variant"))).otherwise(F.col("type"))
    gain = F.col("weight") * reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(factors.items())[1:], F.when(kind == next(iter(factors)), next(iter(factors.values())))).otherwise(0.0)
    near = undirected(edges, distinct=False).select("node", "nbr", "type", gain.alias("gain"))
    near = near.groupBy("node", "nbr").agg(F.max("gain").alias("gain"), F.max_by("type", F.struct("gain", "type")).alias("type"))
    if concept_file is not None:
        total = concept_file.agg(F.countDistinct("file").alias("total"))
        common = concept_file.groupBy("concept").agg(F.countDistinct("file").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > ratio * F.col("total")).select("concept")  # total: one row
        near = near.join(common.withColumnRenamed("concept", "node"), "node", "left_anti").join(common.withColumnRenamed("concept", "nbr"), "nbr", "left_anti")
    keys = [*by, "node"]
    start = seeds.groupBy(*keys).agg(F.max("weight").alias("weight"))
    none = F.lit(None).cast("string")
    step = lambda node, kind: F.array(F.struct(node.alias("concept"), kind.alias("edge_type")))
    start = start.withColumn("path", step(F.col("node"), none))
    reached = start.select(*keys, "weight", F.lit(0).alias("hop"), none.alias("via"), none.alias("edge_type"), "path")
    front = start
    for h in range(1, hops + 1):
        grown = front.join(near, "node").select(*by, F.col("nbr"), (F.col("weight") * F.col("gain")).alias("weight"), F.col("node").alias("via"), "type", F.concat("path", step(F.col("nbr"), F.col("type"))).alias("path")).where(F.col("weight") >= least)
        best = grown.groupBy(*by, "nbr").agg(F.max(F.struct("weight", "via", "type", "path")).alias("w"))
        best = best.select(*by, F.col("nbr").alias("node"), "w.weight", F.lit(h).alias("hop"), "w.via", F.col("w.type").alias("edge_type"), "w.path")
        reached = reached.unionByName(best.select(*keys, "weight", "hop", "via", "edge_type", "path"))
        front = best.select(*keys, "weight", "path")
    found = top(reached, keys, [F.desc("weight"), "hop", "via"], 1, "_r").drop("_r")
    return found.withColumn("seed", F.col("path")[0]["concept"])

"""Word senses: definitions of one name grouped by distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch
from .components import connected_components


def worth_checking(occurrences: DataFrame, least: int = 5, files: int = 3) -> DataFrame:
    """Names defined often enough, in enough files, in more than one way."""
    known = occurrences.where("definition <> ''")
    stats = known.groupBy("split_name").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.countDistinct("definition").alias("ways"))
    return stats.where((F.col("n") >= least) & (F.col("files") >= files) & (F.col("ways") > 1))


def _labels(x: np.ndarray, eps: float) -> np.ndarray:
    """Components of points within ``eps``, numbered by their first point.

    A matrix product tells most distances from ``eps``; what it leaves in doubt is subtracted.
    """
    label, mark, bound = np.full(len(x), -1), -1, eps * eps
    square = (x**2).sum(1)
    for seed in range(len(x)):
        if label[seed] >= 0:
            continue
        edge, mark, rest = np.array([seed]), mark + 1, x[seed + 1 :]
        label[seed] = mark
        while len(edge):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(edge), 64):
                some = edge[at : at + 64]
                with np.errstate(invalid="ignore"):
                    both = square[seed + 1 :, None] + square[some]
                    over, doubt = both - 2 * (rest @ x[some].T) - bound, 1e-9 * (both + bound)
                    near |= (over < -doubt).any(1)
                    i, j = np.nonzero(np.abs(over) <= doubt)
                    near[i[np.sqrt(((rest[i] - x[some[j]]) ** 2).sum(1)) <= eps]] = True
            edge = np.flatnonzero(near & (label[seed + 1 :] < 0)) + seed + 1
            label[edge] = mark
    return label


def clusters(vectors: DataFrame, eps: float = 0.55, by: str = "name", key: str = "id", vector: str = "emb", most: int = 20_000) -> DataFrame:
    """``(by, key, cluster)``: density clusters of single points, which are the components of the graph of pairs within ``eps``.

    Clusters are numbered by their first id. A name's definitions are one task
    up to ``most`` of them, as counted; beyond, :func:`sense_components` finds
    the same clusters.
    """
    kind, name = vectors.schema[by].dataType.simpleString(), by
    rows = vectors.select(by, key, vector)

    def run(group, table):
        ids = table[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        label = _labels(np.array(table[vector].to_pylist(), np.float64)[order], eps)
        return pa.table({name: pa.array([group[0].as_py()] * len(ids), table[name].type), key: pa.array(ids[order]), "cluster": pa.array(label, pa.int32())})

    def whole(some: DataFrame) -> DataFrame:
        return some.groupBy(by).applyInArrow(run, f"`{by}` {kind}, `{key}` bigint, cluster int")

    large = rows.groupBy(F.col(by).alias("large")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("large")
    if large.isEmpty():
        return whole(rows)
    here = F.col(by).eqNullSafe(F.col("large"))
    return whole(rows.join(large, here, "left_anti")).unionByName(sense_components(rows.join(large, here, "left_semi"), eps, by, key, vector))


def sense_components(vectors: DataFrame, eps: float = 0.55, by: str = "name", key: str = "id", vector: str = "emb", block: int = 4096) -> DataFrame:
    """What :func:`clusters` gives, for names of any size.

    A name's rows are dealt to blocks of ``block`` on average, two at least, and
    a task holds two blocks of a name. It tells only which of its rows are
    connected there, a row each, so near copies don't become pairs; the
    components of what all tasks tell are the name's. Every row is a node of its
    own, so an id may repeat.
    """
    scratch = Scratch(vectors.sparkSession, "senses")
    rows = scratch.save(vectors.select(F.col(by).alias("name"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("emb")).withColumn("node", F.monotonically_increasing_id()), "rows")
    sizes = rows.groupBy(F.col("name").alias("of")).agg(F.greatest(F.lit(2), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, F.col("name").eqNullSafe(F.col("of"))).withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("name", "node", "emb", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("home <> other")

    def run(table):
        nodes = table["node"].to_numpy()
        _, first, label = np.unique(_labels(np.array(table["emb"].to_pylist(), np.float64), eps), return_index=True, return_inverse=True)
        return pa.table({"a": pa.array(nodes), "b": pa.array(nodes[first[label]])})

    stars = dealt.groupBy("name", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high")).applyInArrow(run, "a bigint, b bigint")
    found = connected_components(stars, scratch)
    label = rows.select("name", "id", "node").join(found, "node", "left").select("name", "id", F.coalesce("component", "node").alias("component"))
    first = label.groupBy("name", "component").agg(F.min("id").alias("first"))
    number = first.select(F.col("component"), (F.row_number().over(W.partitionBy("name").orderBy("first", "component")) - 1).cast("int").alias("cluster"))
    return label.join(number, "component").select(F.col("name").alias(by), F.col("id").alias(key), "cluster")


def polysemy_summary(labels: DataFrame, by: str = "name") -> DataFrame:
    """One row: names of several senses, names looked at, senses in all, from :func:`clusters`."""
    each = labels.groupBy(by).agg(F.countDistinct("cluster").alias("senses"))
    return each.agg(F.count(F.when(F.col("senses") > 1, 1)).alias("concepts_with_multiple_meanings"), F.count("*").alias("total_concepts_checked"), F.coalesce(F.sum("senses"), F.lit(0)).alias("total_clusters"))


def representatives(vectors: DataFrame, labels: DataFrame, by: str = "name", key: str = "id", vector: str = "emb") -> DataFrame:
    """Per cluster the member nearest its centre, and how tight it is (1 - mean distance)."""
    rows = labels.join(vectors.select(key, F.col(vector).alias("emb")), key)
    each = rows.select(by, "cluster", key, F.posexplode("emb").alias("d", "x"))
    centre = each.groupBy(by, "cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("c"))
    far = each.join(centre, [by, "cluster", "d"]).groupBy(by, "cluster", key).agg(F.sqrt(F.sum(F.pow(F.col("x").cast("double") - F.col("c"), F.lit(2)))).alias("dist"))
    far = far.withColumn("dist", F.round("dist", 6))
    return far.groupBy(by, "cluster").agg(F.count("*").alias("members"), F.min_by(key, F.struct("dist", key)).alias("representative"), F.round(1.0 - F.avg("dist"), 4).alias("distinctiveness"))

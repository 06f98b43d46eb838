"""Near-duplicate vectors: sign hashing in several tables, exact cosine, components.

The signs of a vector's products with random hyperplanes make a short key; two
vectors at angle a share a bit with probability 1 - a / pi. A table's keys have
so many bits that a bucket holds :data:`LOAD` vectors on average, and there are
so many tables that a pair at the threshold itself meets in one of them with
probability ``recall``; both follow from the number of vectors alone.

Within a bucket all pairs are compared by one matrix product in double
precision, and only counts and a spanning set of links leave the task. A pair
that met in an earlier table is left to that table, so links are counted once.
A bucket above :data:`BLOCK` vectors is cut into blocks, and every pair of
blocks is a task of its own. Equal vectors are one class with a count from the
start, whatever their number.

Defined cases: vectors that are null, zero, empty or hold null or non-finite
components link with nothing, and so do rows with a null id, whose component is
null; vectors of different lengths don't link; rows that repeat an id are
vectors of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, spread_join

#: Vectors a bucket holds on average.
LOAD = 512
#: Vectors that one task compares with as many others.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def plan(n: int, threshold: float, recall: float, load: int = LOAD) -> tuple[int, int]:
    """Bits a key, and tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2) / load))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _keys(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds ``keys``: one integer a table."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vec"))
            sizes = np.diff(column.offsets.to_numpy())
            keys = np.zeros((len(column), tables), np.int32)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                signs = _matrix(column.take(pa.array(rows))).astype(np.float64) @ planes[d] > 0
                keys[rows] = signs.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, keys array<int>")


def _compare(threshold: float):
    """Links among one bucket's vectors, or between two of its blocks."""

    def run(key, table):
        t, i, j = (key[k].as_py() for k in (0, 3, 4))
        unit = _matrix(table["vec"].combine_chunks()).astype(np.float64)
        unit = unit / np.abs(unit).max(1, keepdims=True)  # lest squares overflow or vanish
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        node, times = table["node"].to_numpy(), table["times"].to_numpy()
        keys = _matrix(table["keys"].combine_chunks())
        block = table["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        ends: list[np.ndarray] = []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            a, b = np.nonzero(unit[some] @ unit[right].T >= threshold)
            a, b = some[a], right[b]
            new = (a < b) if i == j else np.ones(len(a), bool)
            a, b = a[new], b[new]
            if t:
                new = ~(keys[a, :t] == keys[b, :t]).any(1)
                a, b = a[new], b[new]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            ends.append(np.stack([a, b]))
        a, b = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
        while len(a):  # smallest index reachable within the task
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "root": pa.array(node[root[hit]])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """``(key, n_links bigint, component_id, kept)`` for every row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec"))
    rows = rows.withColumn("usable", usable(F.col("vec")) & F.col("id").isNotNull())
    classes = rows.where("usable").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), threshold, recall)
    keyed = scratch.save(_keys(classes, bits, tables, seed), "keyed")

    dealt = keyed.select("node", "times", "vec", "keys", F.posexplode("keys").alias("table", "bucket"), F.size("vec").alias("d"))
    full = keyed.select(F.posexplode("keys").alias("table", "bucket"), F.size("vec").alias("d")).groupBy("table", "bucket", "d").count().where(F.col("count") > BLOCK)
    full = full.select("table", "bucket", "d", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(full, ["table", "bucket", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = dealt.groupBy("table", "bucket", "d", "i", "j").applyInArrow(_compare(threshold), "node bigint, links bigint, root bigint")
    found = scratch.save(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    placed = components.join(classes.select("node", "rep"), "node")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    placed = spread_join(placed.select("node", "component"), least, "component").select("node", "least")

    known = classes.join(links, "node", "left").join(placed, "node", "left")
    known = known.select("vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    known = scratch.save(known, "known")
    linked = spread_join(rows.where("usable").select("vec", "id"), known, "vec", counts=classes.select("vec", F.col("times").alias("_n"))).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    out = out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return scratch.last(out)

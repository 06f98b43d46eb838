"""Vector arithmetic: on columns for small joins, on blocks of rows for large ones."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def hashed_embedding(tokens: Column, width: int = 64) -> Column:
    """A deterministic stand-in for a model: unit vector of signed token hashes."""
    at = lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % width
    sign = lambda t: F.when(F.conv(F.substring(F.md5(t), 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.when(at(t) == i, sign(t)).otherwise(0.0)))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def _best(i: np.ndarray, j: np.ndarray, v: np.ndarray, k: int):
    """The ``k`` pairs of largest value of every ``i``, smaller ``j`` first on ties."""
    order = np.lexsort((j, -v, i))
    i, j, v = i[order], j[order], v[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], v[keep]


def _unit(table: pa.Table) -> np.ndarray:
    x = np.array(table["emb"].to_pylist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _six(value: np.ndarray) -> np.ndarray:
    return np.floor(value * 1e6 + 0.5) / 1e6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length; null components are NaN."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _nearest(x: np.ndarray, y: np.ndarray, least: float, k: int, after: np.ndarray | None = None, rows: int = 256, columns: int = 4096):
    """(i, j, cosine) of the ``k`` best rows of ``y`` for each row of ``x``, of cosine ``least`` or more as rounded to six digits, smaller ``j`` first; with ``after`` no j below that of the row.

    Products in single precision only tell which pairs may be among the best so
    far; those are multiplied in double precision.
    """
    x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    low, high = (np.nan_to_num(m.astype(np.float32), posinf=0.0, neginf=0.0) for m in (x, y))
    slack = np.float32(1e-6 + 2.4e-7 * x.shape[1])
    out = []
    for at in range(0, len(x), rows):
        n = len(x[at : at + rows])
        bound = np.full(n, least)
        i, j, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for to in range(0, len(y), columns):
            if after is not None and to + columns <= after[at : at + n].min():
                continue
            value = low[at : at + n] @ high[to : to + columns].T
            if after is not None:
                value[np.arange(to, to + value.shape[1]) < after[at : at + n, None]] = -2.0
            floor = bound.astype(np.float32) - slack
            hit = np.flatnonzero(value >= floor[:, None])
            if len(hit) > 4 * n * k:
                floor = np.maximum(floor, np.partition(value, -k, axis=1)[:, -k] - 2 * slack)
                hit = np.flatnonzero(value >= floor[:, None])
            a, b = np.divmod(hit, value.shape[1])
            found = _six(np.einsum("ij,ij->i", x[at + a], y[to + b]))
            keep = found >= least
            if after is not None:
                keep &= to + b >= after[at + a]
            i, j, v = _best(np.concatenate([i, a[keep]]), np.concatenate([j, to + b[keep]]), np.concatenate([v, found[keep]]), k)
            full = np.flatnonzero(np.bincount(i, minlength=n) == k)
            bound[full] = v[np.searchsorted(i, full, side="right") - 1]
        out.append((at + i, j, v))
    return [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def _side(rows: int, block: int | None) -> int:
    """Blocks of a side: eight at least beyond a few thousand rows, so that all cores have pairs of them, and of 32,768 rows at most, for each row is sent to every block of the other side."""
    return max(1, math.ceil(rows / block)) if block else max(1, min(8, rows // 1024), math.ceil(rows / 32768))


def _apart(rows: DataFrame, a: str, b: str, pairs: int) -> DataFrame:
    """Rows by pair of blocks, which are little to read and much to do, so small partitions are not put together."""
    return rows.repartition(min(pairs, 4096), a, b)


def _best_pairs(rows: DataFrame, least: float, k: int, block: int | None) -> DataFrame:
    """``(i, j, sim)`` of :func:`similar_pairs` with ``k``: blocks are ranges of ids, so that i is of the lower one."""
    blocks = _side(rows.count(), block)
    cuts = sorted(set(rows.approxQuantile("id", [n / blocks for n in range(1, blocks)], 0.001))) if blocks > 1 else []
    rows = rows.select("id", "emb", sum((F.when(F.col("id") > int(c), 1).otherwise(0) for c in cuts), F.lit(0)).alias("home"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
    rows = rows.withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other"))

    def compare(group, table):
        low, high = group[0].as_py(), group[1].as_py()
        table = table.sort_by("id")
        ids, home, x = table["id"].to_numpy(), table["home"].to_numpy(), _matrix(table["emb"])
        left, right = home == low, home == high
        # within a block, a row's pairs begin at the next larger id
        i, j, v = _nearest(x[left], x[right], least, k, np.searchsorted(ids, ids, side="right") if low == high else None)
        return pa.table({"i": pa.array(ids[left][i], pa.int64()), "j": pa.array(ids[right][j], pa.int64()), "sim": pa.array(v, pa.float64())})

    return _apart(rows, "low", "high", (len(cuts) + 1) * (len(cuts) + 2) // 2).groupBy("low", "high").applyInArrow(compare, "i bigint, j bigint, sim double")


def similar_pairs(vectors: DataFrame, least: float, key: str = "id", vector: str = "emb", block: int | None = None, by: str | None = None, euclidean: bool = False, k: int | None = None) -> DataFrame:
    """``(i, j, sim)`` with i < j and cosine at least ``least``; with ``euclidean``, ``(i, j, dist)`` at most ``least``.

    Rows are dealt to blocks, and each pair of blocks is one matrix product in
    one task: every pair is compared once, no pair below the bound becomes a
    row, and a task holds two blocks whatever the table's size. ``by`` restricts
    pairs to equal values of a column. With ``k`` cosines are rounded to six
    digits before they meet the bound, and a task gives no more than the ``k``
    best of every ``i``, so that what leaves it doesn't grow with the pairs.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("emb"), (F.col(by) if by else F.lit(0)).cast("string").alias("part")).where("id is not null and emb is not null")
    if k and not by and not euclidean:
        return _best_pairs(rows, least, k, block)
    blocks = max(1, math.ceil(rows.count() / (block or 4096)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other"))
    name = "dist" if euclidean else "sim"

    def compare(group, table):
        low, high = group[1].as_py(), group[2].as_py()
        ids, home = table["id"].to_numpy(), table["home"].to_numpy()
        x = np.array(table["emb"].to_pylist(), np.float64) if euclidean else _unit(table)
        left, right = np.flatnonzero(home == low), np.flatnonzero(home == high)
        found = []
        step = 16 if euclidean else 512
        for at in range(0, len(left), step):
            some = left[at : at + step]
            if euclidean:
                value = np.sqrt(((x[some][:, None] - x[right][None]) ** 2).sum(2))
                hit = value <= least
            else:
                value = x[some] @ x[right].T
                value = _six(value) if k else value
                hit = value >= least
            a, b = np.nonzero(hit)
            v, a, b = value[a, b], ids[some[a]], ids[right[b]]
            keep = a < b if low == high else np.ones(len(a), bool)
            pairs = np.minimum(a, b)[keep], np.maximum(a, b)[keep], v[keep]
            found.append(_best(*pairs, k) if k else pairs)
        i, j, v = (np.concatenate(z) if found else np.empty(0) for z in (list(zip(*found, strict=True)) or [[], [], []]))
        if k:
            i, j, v = _best(i, j, v, k)
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), name: pa.array(v, pa.float64())})

    return rows.groupBy("part", "low", "high").applyInArrow(compare, f"i bigint, j bigint, {name} double")


def similar_across(left: DataFrame, right: DataFrame, least: float, k: int, key: str = "issue_id", name: str = "concept", vector: str = "emb", block: int | None = None) -> DataFrame:
    """``(key, name, sim)``: of every left row the right rows of cosine ``least`` or more, rounded to six digits.

    Both sides are dealt to blocks and a task multiplies one block of each. It
    gives the ``k`` best of a left row, smaller names first on ties, so the whole
    has at most ``k`` times the right blocks for each left row; rank them to end.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, key), (right, name))}
    held = {df.schema[vector].dataType.simpleString() for df in (left, right)}
    held = "array<float>" if held == {"array<float>"} else "array<double>"
    left = left.select(F.col(key).alias("l"), F.lit(None).cast(kinds[name]).alias("r"), F.col(vector).cast(held).alias("emb")).where("l is not null and emb is not null")
    right = right.select(F.lit(None).cast(kinds[key]).alias("l"), F.col(name).alias("r"), F.col(vector).cast(held).alias("emb")).where("r is not null and emb is not null")
    many = {side: _side(df.count(), block) for side, df in (("l", left), ("r", right))}
    dealt = lambda df, c, own, other: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(many[c])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many["r" if c == "l" else "l"] - 1))))
    rows = dealt(left, "l", "lb", "rb").unionByName(dealt(right, "r", "rb", "lb"))

    def compare(table):
        table = table.sort_by([("l", "ascending"), ("r", "ascending")])
        missing = table["l"].is_null().to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0, bool)
        a, b = np.flatnonzero(~missing), np.flatnonzero(missing)
        i, j, v = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if len(a) and len(b):
            x = _matrix(table["emb"])
            i, j, v = _nearest(x[a], x[b], least, k)
            i, j = a[i], b[j]
        return pa.table({key: table["l"].take(pa.array(i)), name: table["r"].take(pa.array(j)), "sim": pa.array(v, pa.float64())})

    return _apart(rows, "lb", "rb", many["l"] * many["r"]).groupBy("lb", "rb").applyInArrow(compare, f"`{key}` {kinds[key]}, `{name}` {kinds[name]}, sim double")

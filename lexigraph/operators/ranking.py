"""Explicit tie-breaks: ranks, top-k and arg-max with a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.lineage import cut

#: Rows of a cut table up to which a join broadcasts it.
FEW = 500_000


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based row numbers within ``by``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the filter on row numbers lets Spark cut groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def scaled_to_max(score: str, by: list[str]) -> Column:
    """Score over its group's largest, unless that is not positive."""
    most = F.max(score).over(W.partitionBy(*by))
    return F.when(most > 0, F.col(score) / most).otherwise(F.col(score))


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows as counted before, marked for broadcast if those are few."""
    return F.broadcast(df) if rows <= FEW else df


def classes(df: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of one key of every class, ``(key, of)``): keys with the same rows ``by`` are a class, for which its smallest key stands.

    What depends on these rows alone is found once a class, and joined to its keys in the end.
    """
    said = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*by))).alias("said"))
    first = said.groupBy("said").agg(F.min(key).alias("of"))
    members = cut(said.join(first, said["said"].eqNullSafe(first["said"])).select(key, "of"))
    return df.join(members.where(F.col(key) == F.col("of")).select(key), key, "left_semi"), members


def sampled(df: DataFrame, key: str, n: int, salt: str = "42") -> DataFrame:
    """``n`` rows by a hash order: as random as a seed, and the same on every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), key).limit(n)


def stratified(df: DataFrame, by: str, key: str, least: int, most: int, salt: str = "42") -> DataFrame:
    """Up to ``most`` rows of every group that has ``least`` or more, by hash order."""
    size = F.count("*").over(W.partitionBy(by))
    rows = df.withColumn("group_size", size).where(F.col("group_size") >= least)
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), F.col(key)]
    return top(rows, [by], order, most, "pick").drop("group_size")

"""Near-synonyms from vectors: candidate pairs, two tracks, judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import similar_pairs
from .ranking import top


def candidates(vectors: DataFrame, threshold: float = 0.55, k: int = 20, **columns) -> DataFrame:
    """For every row the ``k`` most similar rows of larger index, at the threshold or above: ``(i, j, sim, rank)``."""
    pairs = similar_pairs(vectors, threshold, k=k, **columns)
    return top(pairs, ["i"], [F.desc("sim"), "j"], k)


def tracks(pairs: DataFrame, naming: float = 0.85, low: float = 0.55, high: float = 0.85) -> DataFrame:
    """Pairs sure enough to be naming variants, and those a judge must see."""
    track = F.when(F.col("sim") >= naming, "naming_variant").when((F.col("sim") >= low) & (F.col("sim") < high), "semantic")
    return pairs.withColumn("track", track).where("track is not null")


def edges(tracked: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Synonym edges ``(src, dst, type, weight, track, reason)``; semantic pairs need a verdict ``(i, j, yes, reason)``."""
    sure = tracked.where("track = 'naming_variant'").select("i", "j", "sim", "track", F.lit(None).cast("string").alias("reason"))
    out = sure
    if verdicts is not None:
        said = tracked.where("track = 'semantic'").join(verdicts.where("yes"), ["i", "j"]).select("i", "j", "sim", "track", "reason")
        out = sure.unionByName(said)
    out = out.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.max_by(F.struct("sim", "track", "reason"), "sim").alias("e"))
    return out.select("src", "dst", F.lit("synonym").alias("type"), F.col("e.sim").alias("weight"), F.col("e.track").alias("track"), F.col("e.reason").alias("reason"))

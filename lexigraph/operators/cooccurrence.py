"""Concepts that occur in the same context, scored and put to a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("jaccard", "pmi", "npmi")


def contexts(occurrences: DataFrame, drop_module_level: bool = True) -> DataFrame:
    """``(context, concept, subdomain)``, each once; a context is a file, class and function."""
    rows = occurrences
    if drop_module_level:
        rows = rows.where("coalesce(class_name, '') <> '' or coalesce(function_name, '') <> ''")
    key = F.struct("file_path", F.coalesce("class_name", F.lit("")).alias("c"), F.coalesce("function_name", F.lit("")).alias("f"))
    return rows.where("split_name <> ''").select(key.alias("context"), F.col("split_name").alias("concept"), "subdomain").distinct()


def cooccurrence(members: DataFrame, min_count: int = 3, normalization: str = "jaccard", threshold: float | None = 0.05, partition: bool = True, cross_factor: float = 0.3) -> DataFrame:
    """Scored pairs a < b from ``(context, concept, subdomain)`` rows.

    A concept's total counts contexts of two concepts or more; the number of
    contexts counts all. A pair that mostly leaves its main subdomain is damped.
    The self join is an equality on the context, so it is as large as the sum of
    squared context sizes; contexts, not concepts, carry the skew, and the join's
    skew handling splits them.
    """
    if normalization not in SCORES:
        raise ValueError(f"normalization is one of {SCORES}")
    rows = members.select("context", "concept", "subdomain")
    left, right = rows.withColumnsRenamed({"concept": "a"}), rows.select("context", F.col("concept").alias("b"))
    pairs = left.join(right, "context").where("a < b")
    by_subdomain = pairs.groupBy("a", "b", "subdomain").agg(F.count("*").alias("n"))
    counts = by_subdomain.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "subdomain")).alias("main")).where(F.col("n") >= min_count)
    shared = rows.groupBy("context").agg(F.count("*").alias("k")).where("k >= 2")
    totals = rows.join(shared, "context", "left_semi").groupBy("concept").agg(F.count("*").alias("total"))
    contexts = rows.agg(F.countDistinct("context").alias("contexts"))
    out = counts.join(totals.select(F.col("concept").alias("a"), F.col("total").alias("source_total")), "a").join(totals.select(F.col("concept").alias("b"), F.col("total").alias("target_total")), "b").crossJoin(F.broadcast(contexts))  # contexts: one row
    n, ta, tb, c = (F.col(x).cast("double") for x in ("n", "source_total", "target_total", "contexts"))
    pmi = F.log2((n / c) / ((ta / c) * (tb / c)))
    raw = {"jaccard": n / (ta + tb - n), "pmi": pmi, "npmi": F.try_divide(pmi, -F.log2(n / c))}[normalization]
    ratio = -F.col("main.m") / n
    weight = F.when(ratio < 0.5, F.col("raw_score") * cross_factor).otherwise(F.col("raw_score")) if partition else F.col("raw_score")
    out = out.withColumn("raw_score", raw).withColumn("same_subdomain_ratio", ratio).withColumn("weight", weight)
    if threshold is not None:
        out = out.where(F.col("weight") >= threshold)
    return out.select("a", "b", F.col("n").alias("cooccurrence_count"), "source_total", "target_total", F.col("main.subdomain").alias("dominant_subdomain"), "same_subdomain_ratio", (F.col("same_subdomain_ratio") < 0.5).alias("cross_subdomain"), "raw_score", "weight")
